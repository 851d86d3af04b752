"""huegrain: perceptual palette analytics over product catalogues, as lazy Spark plans."""
