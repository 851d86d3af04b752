"""Awkward cases of the text operators: extreme and null ids, ties, hot shards, shared folders."""

import collections
import types

import pytest

from huegrain.llm.chat_format import render_chats
from huegrain.llm.common import shared_dir
from huegrain.llm.exact_dedup import exact_dedup
from huegrain.llm.line_dedup import line_dedup


def test_extreme_ids_stay(spark):
    least, most = -(2**63), 2**63 - 1
    rows = [(least, "a b"), (5, "ab"), (most, "c"), (None, "d"), (None, "e"), (4, "e"), (most, "f"), (least, "f")]
    got = {(r.doc_id, r.text_sha256): (r.keep_id, r.group_size, r.kept) for r in exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    by = collections.Counter((k, n, kept) for k, n, kept in got.values())
    assert by == {(least, 2, True): 2, (least, 2, False): 2, (most, 1, True): 1, (None, 1, True): 1, (4, 2, True): 1, (4, 2, False): 1}


def test_tied_turns_are_ordered_by_text(spark):
    """{(1, user, a)} logged before {(1, user, a), (1, user, b)}: the first is a prefix of the second, whatever the texts' hashes."""
    rows = []
    for k in range(8):
        a, b = f"a{k}", f"b{k}"
        rows += [(2 * k, 1, "user", a), (2 * k + 1, 1, "user", b), (2 * k + 1, 1, "user", a)]
    got = render_chats(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"), before="", between=":", after=";").collect()
    assert sorted((r.conv_id, r.n_turns, r.rendered) for r in got) == [(2 * k + 1, 2, f"user:a{k};user:b{k};") for k in range(8)]


def test_chats_of_awkward_tables(spark):
    schema = "conv_id long, turn int, role string, text string, row string, said string, rendered string"
    long = "word " * 100_000
    rows = [(1, 1, "user", "hi"), (1, 1, "user", "hi"), (2, 1, "user", "hi"), (None, 1, "user", "hi"), (None, 2, "user", "x"), (3, None, None, None), (3, 1, "user", long), (4, 1, "user", None), (5, 1, "user", "")]
    got = render_chats(spark.createDataFrame([(*r, "", "", "") for r in rows], schema), before="", between=":", after=";").collect()
    assert sorted(map(repr, ((r.conv_id, r.n_turns, r.n_copies, r.rendered) for r in got))) == sorted(map(repr, [(1, 2, 1, "user:hi;user:hi;"), (None, 1, 1, "user:x;"), (3, 2, 1, f":;user:{long};"), (4, 1, 1, "user:;"), (5, 1, 1, "user:;")]))
    assert render_chats(spark.createDataFrame([], schema)).count() == 0


def test_line_dedup_of_hot_shards_and_null_ids(spark):
    hot, cold = "a line that very many documents have", "a line that three documents have, not more"
    rows = [(i, hot) for i in range(200)] + [(i, f"{hot}\n{cold}") for i in (300, 301, 302)] + [(None, hot), (None, cold), (7, hot), (7, hot)]
    got = line_dedup(spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, drops string, h1 long"), keys_per_shard=1).collect()
    kept = collections.Counter((r.doc_id, r.text) for r in got)
    assert kept[302, f"{hot}\n{cold}"] == 1 and kept[None, hot] == 1 and kept[None, cold] == 1 and kept[7, ""] == 3 and kept[300, ""] == 1
    assert len(got) == len(rows) and sum(r.n_dropped for r in got) == 202 + 2 + 2


def test_a_cluster_needs_a_shared_folder():
    def session(master, **conf):
        context = types.SimpleNamespace(master=master, getConf=lambda: conf)
        return types.SimpleNamespace(sparkContext=context, conf=types.SimpleNamespace(get=lambda key, default=None: conf.get(key, default)))

    assert shared_dir(session("spark://host:7077", **{"spark.checkpoint.dir": "hdfs:///x/"})) == "hdfs:///x"
    assert shared_dir(session("local[4]")).startswith("file:///")
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1000]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(session(master))


def test_scratch_tables_go(spark):
    from huegrain.llm.common import materialize, scratch

    def there(path):
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)

    with scratch() as outer:
        with scratch() as keep:
            gone = materialize(spark.range(3), "gone")
            kept = keep(materialize(gone.selectExpr("id + 1 AS id"), "kept"))
        assert not there(gone._written) and there(kept._written) and kept.count() == 3
        last = outer(materialize(kept, "last"))
    assert not there(kept._written) and sorted(r.id for r in last.collect()) == [1, 2, 3]


def test_numbered_rows_give_the_same_components(spark):
    import numpy as np

    from huegrain.llm.common import materialize
    from huegrain.llm.jaccard_join import jaccard_components

    random = np.random.default_rng(3)
    base = [f"w{i}" for i in random.integers(0, 300, 120)]
    texts = [" ".join("z" + w if i in set(random.integers(0, 120, 4)) else w for i, w in enumerate(base)) for _ in range(40)] + [None, "", "a b", " ".join(base)] * 2
    df = materialize(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4), "numbered")
    said = lambda **how: sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(df, few=3, **how).collect())
    assert said() == said(numbered=True) and len(said()) == len(texts)
