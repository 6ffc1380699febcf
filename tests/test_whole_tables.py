"""Queries without SQL against brute force."""

import pyarrow.parquet as pq
import pytest

import __spark_entry__
from seqloom.plans import catalog

SF = "/root/testdata/sf0.001"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_whole_texts_are_compared(spark, tmp_path):
    odd = [("a\nb", "a\nc"), ("é", "è"), (" 　x y\t", "x\n y"), ("", ""), ("one", "one\nmore lines\nof text"), ("日本\n語", "日本\n誤 ")]
    spark.createDataFrame([(i, r) for i, (r, _) in enumerate(odd)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, h) for i, (_, h) in enumerate(odd)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert "text_matches" in __spark_entry__.queries()
    docs = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    texts = dict(zip(docs["doc_id"], docs["text"]))
    items = pq.read_table(f"{SF}/benchmark.parquet").to_pydict()
    dealt = [t for _, t in sorted(zip(items["item_id"], items["text"]))]
    pairs = {i: (dealt[i % len(dealt)], t) for i, t in texts.items()}
    for folder, known in ((str(tmp_path), dict(enumerate(odd))), (SF, pairs)):
        got = {r["doc_id"]: r for r in catalog.ALONE["text_matches"](spark, folder).collect()}
        assert got.keys() == known.keys()
        for i, (r, h) in known.items():
            assert got[i]["exact"] == (r.split() == h.split())
            if len(r) * len(h) < 100_000:
                a, b = r.strip(), h.strip()
                assert got[i]["similarity"] == pytest.approx(1 - distance(a, b) / max(len(a), len(b), 1), abs=1e-6)


def whole_log(folder):
    c, p = (pq.read_table(f"{folder}/{t}.parquet").to_pydict() for t in ("customer", "part"))
    end = max(p["p_partkey"])
    step = max(1, int(end**0.5) // 8)
    log = [(k, n % 3 == 0, k * 37 % end + 1, k * 37 % end + 1 + n * step, n % 5 - 2) for k, n in sorted(zip(c["c_custkey"], c["c_nationkey"]))]
    return log, dict(zip(p["p_partkey"], p["p_size"])), end


@pytest.mark.parametrize("tag", ["plus", "cover", "neg"])
def test_ranges_reach_the_whole_sequence(spark, tag):
    folder = "/root/testdata/sf0.1" if tag == "plus" else "/root/testdata/sf0.01"
    log, sizes, end = whole_log(folder)
    now, wanted = {k: v % 7 - 3 for k, v in sizes.items()}, {}
    for op, query, a, b, t in log:
        at = [i for i in range(a, b + 1) if i in now]
        if query and at:
            wanted[op] = [now[i] for i in at]
        elif not query:
            for i in at:
                now[i] = {"plus": now[i] + t, "cover": t, "neg": -now[i]}[tag]
    got = {r["op_idx"]: r for r in catalog.QUERIES[f"range_{tag}"](spark, folder).collect()}
    assert got.keys() == wanted.keys() and max(b for _, query, _, b, _ in log if query) >= 0.99 * end
    for op, v in wanted.items():
        r = got[op]
        if tag == "neg":
            assert r["min_neg"] == min(100, *v)
        else:
            assert (r[f"sum_{tag}"], r[f"sqrsum_{tag}"]) == (sum(v), sum(x * x for x in v))
