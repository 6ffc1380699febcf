"""Text scores and table preparation against plain Python."""

import math
import random
import re
import sys
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from seqloom.operators import preparation as P
from seqloom.operators import scoring as S
from seqloom.plans import catalog
from seqloom.plans import preparation as plans

SF = "/root/testdata/sf0.001"


def grams(w, n):
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def counts(hyp, refs):
    m, g = [], []
    for n in range(1, 6):
        h, top = grams(hyp, n), Counter()
        for r in refs:
            top |= grams(r, n)
        m.append(sum(min(c, top[x]) for x, c in h.items()))
        g.append(sum(h.values()))
    return m, g, len(hyp), min((abs(len(r) - len(hyp)), len(r)) for r in refs)[1], min(map(len, refs))


def smooth(method, m, g, size):
    """Four precisions, in a loop as the ways are usually told."""
    d = [max(1, x) for x in g]
    p = [a / b for a, b in zip(m, d)]
    out, zeros = p[:4], 0
    for i in range(4):
        if method == 0 and not m[i]:
            out[i] = sys.float_info.min
        if method == 1 and not m[i]:
            out[i] = 0.1 / d[i]
        if method == 2:
            out[i] = (m[i] + 1) / (d[i] + 1)
        if method == 3 and not m[i]:
            zeros += 1
            out[i] = 1 / (2**zeros * d[i])
        if method in (4, 7) and not m[i] and size:
            out[i] = (i + 5 / math.log(size)) / d[i]
        if method == 6 and i > 1:
            prior = out[i - 1] ** 2 / out[i - 2] if out[i - 2] else 0
            out[i] = (m[i] + 5 * prior) / (g[i] + 5)
    if method in (5, 7):
        old, last = [*out, p[4]], out[0] + 1
        for i in range(4):
            last = out[i] = (last + old[i] + old[i + 1]) / 3
    return out


def penalty(size, ref):
    return 1 if size > ref else 0 if size == 0 else math.exp(1 - ref / size)


def log_mean(p):
    return sum(math.log(x) for x in p) / len(p)


def plain_bleu(method, c):
    m, g, size, ref, _ = c
    if not m[0]:
        return 0
    p = smooth(method, m, g, size)
    return penalty(size, ref) * math.exp(log_mean(p)) if min(p) > 0 else None


def word_pairs(n=150):
    rng, out = random.Random(2), []
    for i in range(n):
        draw = lambda k: [rng.choice("abcdefg") for _ in range(rng.randint(0, k))]
        ref = draw(14)
        hyp = ref[: rng.randint(0, 14)] + draw(4) if i % 3 else draw(6)
        out.append((hyp, [ref, draw(14)][: 1 + i % 2]))
    return out


@pytest.fixture(scope="module")
def tables(spark):
    pairs = word_pairs()
    return pairs, spark.createDataFrame([(i, h) for i, (h, _) in enumerate(pairs)], "k long, hypothesis array<string>"), spark.createDataFrame([(i, j, r) for i, (_, rs) in enumerate(pairs) for j, r in enumerate(rs)], "k long, ref int, reference array<string>")


def test_sentence_scores(tables):
    pairs, h, r = tables
    parts = S.bleu_parts(h, r, "k")
    rows = parts.select("*", *[S.bleu(i).alias(f"b{i}") for i in range(8)], S.row_bleu().alias("row"), S.plain_bleu().alias("plain")).collect()
    assert len(rows) == len(pairs)
    for x in rows:
        c = counts(*pairs[x["k"]])
        assert ([x[f"m{i}"] for i in range(1, 6)], [x[f"g{i}"] for i in range(1, 6)], x["hyp_len"], x["ref_len"], x["ref_min"]) == c
        for i in range(8):
            if i in (4, 7) and c[2] == 1:
                continue  # its logarithm is 0: null
            want = plain_bleu(i, c)
            assert want is None or x[f"b{i}"] == pytest.approx(want, abs=1e-12), (i, pairs[x["k"]])
        m, g, size, _, short = c
        row = math.exp(sum(math.log(m[i] + (i > 0) + sys.float_info.min) - math.log(g[i] + (i > 0) + sys.float_info.min) for i in range(4)) / 4 + min(0, 1 - (short + 1) / (size + 1)))
        assert x["row"] == pytest.approx(row, rel=1e-9, abs=1e-300)
        if min(m[:4]):
            assert x["plain"] == pytest.approx((1 if size > short else math.exp(1 - short / size)) * math.exp(log_mean([a / b for a, b in zip(m[:4], g[:4])])))
        else:
            assert x["plain"] == 0
    with pytest.raises(ValueError):
        S.smoothed(8)


def test_corpus_scores(tables):
    pairs, h, r = tables
    got = S.summed(S.bleu_parts(h, r, "k")).select(S.bleu(1).alias("b"), S.bleu(2).alias("b2"), S.plain_bleu(1).alias("one")).first()
    all_counts = [counts(*p) for p in pairs]
    m, g = ([sum(c[j][i] for c in all_counts) for i in range(5)] for j in (0, 1))
    size, ref, short = (sum(c[j] for c in all_counts) for j in (2, 3, 4))
    assert got["b"] == pytest.approx(plain_bleu(1, (m, g, size, ref, 0))) and got["b2"] == pytest.approx(plain_bleu(2, (m, g, size, ref, 0)))
    assert got["one"] == pytest.approx((1 if size > short else math.exp(1 - short / size)) * math.exp(log_mean([(a + 1) / (b + 1) for a, b in zip(m[:4], g[:4])])))
    weight = lambda x: 1 if len(x) > 1 or x[0] in ("a", "b") else 0.2
    num, den = [0.0] * 4, [0.0] * 4
    for hyp, refs in pairs:
        for n in range(4):
            have = grams(hyp, n + 1)
            for one in refs:
                want = grams(one, n + 1)
                num[n] += sum(weight(x) * min(c, have[x]) for x, c in want.items())
                den[n] += max(1, sum(weight(x) * c for x, c in want.items()))
    got = S.summed(S.recall_parts(h, r, "k", keywords=["a", "b"])).select("*", S.recall_score().alias("s")).first()
    assert [got[f"m{i}"] for i in range(1, 5)] == pytest.approx(num) and [got[f"g{i}"] for i in range(1, 5)] == pytest.approx(den)
    assert got["s"] == pytest.approx(penalty(size, ref) * math.exp(log_mean([a / b for a, b in zip(num, den)])))


def test_counts_lie_with_their_row(spark, tables):
    """No n-gram moves, and texts are cut in Python as the columns cut them (before, words were cut by the engine several times and shared n-grams were shuffled)."""
    pairs, h, r = tables
    rows = S.together(h, r, "k").persist()
    rows.count()
    plan = S.bleu_parts_of(rows, "k")._jdf.queryExecution().executedPlan().toString().split("InMemoryTableScan")[0]
    assert "Exchange" not in plan and "Aggregate" not in plan
    odd = ["a\x1cb\x85c　d", "ÀÉ ß İ ΑΣ. ..,,-1-2 .5 3,000.-4 a.b ,x &quot;q&amp; <skipped>x-\ny {|}~", "", "٣४ ²x _a-b 日本。語", "a_b\u00a0c\u2028d"]
    df = spark.createDataFrame([(t,) for t in odd], "t string")
    for name, column in (("tokens", S.tokens), ("split", S.split_words), ("normal", S.normal_words)):
        made, cut = S.CUTS[name]
        assert [cut(x["t"]) for x in df.select(made("t").alias("t")).collect()] == [x["w"] for x in df.select(column("t").alias("w")).collect()]
    again = spark.createDataFrame([(1, ["a b c"], [(0, "a b")]), (1, ["b"], [(0, "a b")]), (2, [None], [(0, "a"), (1, None)])], "k long, hypotheses array<string>, references array<struct<ref int, reference string>>")
    got = sorted((x["k"], x["hyp_len"], x["ref_len"], x["ref_min"], x["m1"], x["g1"], x["m2"], x["w1"], x["v1"]) for x in S.parts_of(S.whole_keys(again, "k"), "k", cut="split").collect())
    assert got == [(1, 1, 2, 2, 3, 4, 1, pytest.approx(0.6), 1.0), (1, 3, 2, 2, 3, 4, 1, pytest.approx(0.6), 1.0), (2, 0, 0, 1, 0, 0, 0, 0.0, 2.0)]


def comments_out(text):
    pattern = re.compile(r"//.*?$|/\*.*?\*/|'(?:\\.|[^\\'])*'|\"(?:\\.|[^\\\"])*\"", re.DOTALL | re.MULTILINE)
    return "\n".join(x for x in pattern.sub(lambda k: " " if k[0].startswith("/") else k[0], text).split("\n") if x.strip())


def normal(s):
    s = re.sub(r"\n", " ", re.sub(r"-\n", "", s.replace("<skipped>", "")))
    s = f" {s.replace('&quot;', chr(34)).replace('&gt;', '>').replace('&lt;', '<').replace('&amp;', '&')} ".lower()
    for pattern, by in S.PARTED:
        s = re.sub(pattern, by.replace("$", "\\"), s)
    return s.split()


def test_texts_are_cut_and_cleaned(spark):
    rng = random.Random(4)
    texts = ["int x = 1; // one\n\n/* two\n three */ y();", "s = \"// no\"; c = '\\''; /* \" */ z", "a/**/b//c\n  \nd", "fooBarBaz(a_b[0])", "don't 3,000.50 end. x-\ny 4-5 &quot;q&amp;&lt; <skipped>{}", "", "äÖü ßx_1 日本!?", "<NUM_LIT> <STR_LIT> <CHAR_LIT:a\nb>;<NUM_LIT:7>"]
    texts += ["".join(rng.choice("ab/*\"'\\\n .,-1A&<>_é{") for _ in range(rng.randint(0, 30))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", S.tokens("t").alias("tokens"), S.split_words("t").alias("words"), S.normal_words("t").alias("normal"), S.code_tokens("t").alias("code"), S.plain_literals("t").alias("literals")).collect():
        t = r["t"]
        assert r["tokens"] == re.findall(r"\w+|[^\w\s]", t.lower()) and r["words"] == t.split() and r["normal"] == normal(t), t
        code = re.sub(r"\s+", " ", re.sub("([a-z])([A-Z])", r"\1 \2", re.sub("([^A-Za-z0-9_])", r" \1 ", t))).replace('"', "`").replace("'", "`")
        assert r["code"] == [x for x in code.split(" ") if x], t
        assert r["literals"] == re.sub("<(STR|NUM|CHAR)_LIT:(.*?)>", r"\2", t.replace("<NUM_LIT>", "0").replace("<STR_LIT>", "").replace("<CHAR_LIT>", ""), flags=re.S)
    for r in df.limit(8).select("t", S.without_comments("t").alias("c")).collect():
        assert r["c"] == comments_out(r["t"])
    got = spark.createDataFrame([(["a", "b"],)], "w array<string>").select(S.padded("w", 3, "<", ">").alias("both"), S.padded("w", 2, right=">").alias("right"), S.padded("w", 4).alias("none")).first()
    assert (got["both"], got["right"], got["none"]) == (["<", "<", "a", "b", ">", ">"], ["a", "b", ">"], ["a", "b"])


def test_comments_of_odd_and_long_texts(spark):
    """Marks that nothing closes are looked for once (before, each one to the text's end), and quoted strings may have any length (before, a stack overflow)."""
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab/*\"'\\\n \x01") for _ in range(rng.randint(0, 40))) for _ in range(600)] + ["'// x", "/*/ /**/ /*", "'\\'\\' // a\n\"", "a /* b // c\n 'd' /* */ \" /* \" ' // e"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", S.without_comments("t").alias("c"), S.code_tokens("t").alias("code")).collect()
    assert len(got) == len(texts) and all(r["c"] == comments_out(r["t"]) for r in got)
    n = 200_000
    long = [("'" + "a" * n + "' // b", "'" + "a" * n + "'  "), ('x " /* ' * n, 'x " /* ' * n), ("/* " * n + "\\'" * n + "// c", "/* " * n + "\\'" * n + " ")]
    began = time.time()
    rows = spark.createDataFrame(long, "t string, want string").select("want", S.without_comments("t").alias("c")).collect()
    assert [r["c"] for r in rows] == [r["want"] for r in rows] and time.time() - began < 30


def test_queries_of_scores(spark):
    rows = catalog.ALONE["sentence_scores"](spark, SF).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    words = lambda t: re.findall(r"\w+|[^\w\s]", t.lower())
    texts = [items[i] for i in sorted(items)]
    dealt = lambda d: texts[d % len(texts) : d % len(texts) + 2]
    assert {r["doc_id"] for r in rows} == set(docs)
    for r in rows:
        refs = [words(t) for t in dealt(r["doc_id"])]
        c = counts(words(docs[r["doc_id"]]), refs)
        assert (r["hyp_len"], r["ref_len"], r["ref_min"]) == c[2:] and all((w := plain_bleu(i, c)) is None or r[f"bleu_{i}"] == pytest.approx(w, abs=1e-8) for i in range(8))
    one = catalog.QUERIES["corpus_scores"](spark, SF).first()
    pairs = [(docs[i].split(), [t.split() for t in dealt(i)]) for i in docs]
    all_counts = [counts(*p) for p in pairs]
    total = [[sum(c[j][i] for c in all_counts) for i in range(5)] for j in (0, 1)]
    assert one["bleu"] == pytest.approx(plain_bleu(1, (*total, sum(c[2] for c in all_counts), sum(c[3] for c in all_counts), 0)), abs=1e-8) and 0 <= one["weighted_recall"] <= 1
    means, each = catalog.ALONE["text_match_means"](spark, SF).first(), catalog.ALONE["text_matches"](spark, SF).collect()
    assert means["exact"] == pytest.approx(100 * sum(r["exact"] for r in each) / len(each), abs=0.01) and means["similarity"] == pytest.approx(100 * sum(r["similarity"] for r in each) / len(each), abs=0.01)
    for r in catalog.ALONE["code_texts"](spark, SF).collect():
        assert r["padded"] == len(docs[r["doc_id"]].replace(". ", "; // ").replace(", ", ' "/*" /* ').split()) + 4


def test_chunks_are_shuffled_whole(spark):
    rows = sorted((r["place"], r["rank"]) for r in catalog.ALONE["chunk_shuffle"](spark, SF).collect())
    n, size = len(rows), plans.BATCH
    assert [p for p, _ in rows] == list(range(n)) and sorted(r for _, r in rows) == list(range(n))
    order = [r for _, r in rows]
    chunks = [order[i] // size for i in range(n)]
    assert order != list(range(n)) and len([1 for a, b in zip(chunks, chunks[1:]) if a != b]) == -(-n // size) - 1
    again = sorted((r["place"], r["rank"]) for r in catalog.ALONE["chunk_shuffle"](spark, SF).collect())
    assert again == rows


def test_early_stops(spark):
    by = {}
    for r in spark.read.parquet(f"{SF}/events.parquet").orderBy("user_id", "ts", "event_id").collect():
        by.setdefault(r["user_id"], []).append(r["value"])
    got = {}
    for r in catalog.QUERIES["early_stops"](spark, SF).collect():
        got.setdefault(r["user_id"], []).append((r["epoch"], r["improved"], r["reload"], r["stopped"]))
    for user, scores in by.items():
        best = waited = trials = 0
        want = []
        for e, score in enumerate(scores, 1):
            better = score > best
            reload = False
            if better:
                best, waited = score, 0
            else:
                waited += 1
                if waited >= 4:
                    trials, waited, reload = trials + 1, 0, True
            want.append((e, better, reload, trials == 3))
            if trials == 3:
                break
        assert sorted(got[user]) == want


def test_trees_as_text(spark):
    rng = random.Random(9)

    def tree(depth):
        return (rng.choice("abcdef"), [tree(depth - 1) for _ in range(rng.randint(0, 3))] if depth else [])

    def written(t):
        return t[0] + "🚀" + "".join(map(written, t[1])) + "^🚀"

    trees = {k: tree(4) for k in range(40)}
    nodes = P.parsed_trees(spark.createDataFrame([(k, written(t)) for k, t in trees.items()], "k long, s string"), ["k"], "s")
    texts = {r["k"]: r["text"] for r in P.leaves_as_text(nodes, ["k"]).collect()}
    rules = {}
    for r in P.unfolded(nodes, ["k"]).collect():
        rules.setdefault(r["k"], []).append((r["at"], r["rule"], r["father"], r["last"]))
    for k, t in trees.items():
        def leaves(t):
            return [x for c in t[1] for x in leaves(c)] if t[1] else [t[0]]

        out = []

        def unfold(t, father):
            if t[1]:
                at = len(out)
                out.append(None)
                for c in t[1]:
                    unfold(c, at)
                out[at] = (at, f"{t[0]} -> {' '.join(c[0] for c in t[1])}", father, len(out) - 1)

        unfold(t, -1)
        assert texts[k] == " ".join(leaves(t)) and sorted(rules.get(k, [])) == out


def test_files_and_lookups(spark, tmp_path):
    for name in ("a/x.f", "a/b/y.f", "z.f"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("text")
    files = P.listed_files(spark, str(tmp_path))
    assert sorted(r["name"] for r in files.collect()) == ["x.f", "y.f", "z.f"]
    labels = spark.createDataFrame([("label-x",), ("label-q",)], "label string")
    have, left = P.labelled(files, F.concat(F.lit("label-"), F.regexp_replace("name", r"\.f$", "")), labels, "label")
    assert [r["name"] for r in have.collect()] == ["x.f"] and [r["label"] for r in left.collect()] == ["label-q"]
    samples, problems = spark.createDataFrame([(1, "a"), (2, "b")], "task long, code string"), spark.createDataFrame([(1, "p")], "task long, prompt string")
    assert [tuple(r) for r in P.with_problems(samples.where("task = 1"), problems, "task").collect()] == [(1, "a", "p")]
    with pytest.raises(Exception, match="no problem 2"):
        P.with_problems(samples, problems, "task").collect()
    rows = spark.createDataFrame([(i,) for i in (-9000, -1, 0, 5, 4096, 10**9, 10**9 + 1)], "id long")
    assert [r["rank"] for r in P.ranked(rows, "id").orderBy("id").collect()] == list(range(7)) and P.ranked(rows.where("false"), "id").count() == 0
    assert P.kept_answers(spark.createDataFrame([("IndexError: x",), ("GrammarError",), (None,)], "t string"), "t").count() == 2


def test_files_are_scored(spark, tmp_path):
    lines = [(" ".join(h), [" ".join(r) for r in rs] + [" ".join(rs[0])]) for h, rs in word_pairs(40)]
    for name, text in (("hyp", [h for h, _ in lines]), ("one", [r[0] for _, r in lines]), ("two", [r[1] for _, r in lines])):
        (tmp_path / name).write_text("\n".join(text) + "\n")
    got = S.file_bleu(spark, [f"{tmp_path}/one", f"{tmp_path}/two"], f"{tmp_path}/hyp").first()
    all_counts = [counts(h.split(), [x.split() for x in rs[:2]]) for h, rs in lines]
    m, g = ([sum(c[j][i] for c in all_counts) for i in range(4)] for j in (0, 1))
    size, short = (sum(c[j] for c in all_counts) for j in (2, 4))
    assert (got["hyp_len"], got["ref_min"]) == (size, short)
    assert got["bleu"] == pytest.approx((1 if size > short else math.exp(1 - short / size)) * math.exp(log_mean([a / b for a, b in zip(m, g)])))


def test_only_shared_ngrams_move(spark):
    words = [f"w{i}" for i in range(500)]
    rows = spark.createDataFrame([(1, [words], [(0, ["w1", "w2", "x"]), (1, ["w9", "w9"])]), (2, [["a"], ["a", "b"]], [(0, ["a", "a", "a"])]), (3, [None], [(0, [])])], "k long, hypotheses array<array<string>>, references array<struct<ref: int, reference: array<string>>>")
    assert {tuple(r) for r in S.shared(rows, "k").collect()} == {(1, 1, "w1", 1, 1), (1, 1, "w2", 1, 1), (1, 1, "w9", 1, 2), (1, 2, "w1 w2", 1, 1), (2, 1, "a", 2, 3)}


def test_documents_of_one_id_count_once_each(spark, tmp_path):
    import duckdb

    from seqloom.plans import scoring

    spark.createDataFrame([(5, "a b c a b"), (7, "b b c d")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(2, "a b c"), (2, "a a b c d"), (3, "b c d, e"), (3, ""), (4, "A B c a b")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    for t in ("benchmark", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = {tuple(r) for r in scoring.ngram_matches(spark, str(tmp_path)).collect()}
    assert got == set(con.execute(scoring.ORACLES["ngram_matches"]).fetchall())


def test_edits(spark):
    """Distances of the engine, and of long texts in far less time than their table has cells (200 million took the engine seconds)."""
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abé😀́") for _ in range(rng.randint(0, n)))
    rows = [(word(9), word(70)) for _ in range(400)] + [("", ""), ("same", "same"), ("", "x"), (None, "x"), ("x", None), ("xaby", "xby")]
    df = spark.createDataFrame(rows, "a string, b string")
    for r in df.select("a", "b", F.levenshtein("a", "b").alias("want"), (1 - S.similarity(F.col("a"), F.col("b"))).alias("share")).collect():
        assert r["want"] is r["share"] is None or r["share"] * max(len(r["a"]), len(r["b"]), 1) == pytest.approx(r["want"])
        assert r["want"] is None or S.edits(r["a"], r["b"]) == r["want"]
    a, b = ("".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (2_000, 100_000))
    began = time.process_time()
    assert S.edits(a, b) == S.edits(b, a) >= 98_000 and time.process_time() - began < 2
