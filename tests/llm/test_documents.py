"""Line dedup, near duplicates, language ID, decontamination and the pipeline."""

import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from weirflow.llm import bpe, decontaminate, language_id, line_dedup, near_dedup, queries
from weirflow.llm.shingles import SetSketch, normal, shingle_set

SF = "/root/testdata/sf0.001"


def brute_groups(rows, percent):
    """Numbers of the components that have shingles, all pairs compared."""
    return brute_components(rows, percent, groups=True)


def brute_components(rows, percent, groups=False):
    """(id, set size, smallest id reachable) of every row, all pairs compared."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)})
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                up[top(a)] = top(b)
    if groups:
        return {top(k) for k in range(len(rows)) if sets[k]}
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)].append(i)
    return sorted(((rows[k][0], len(sets[k]), min(least[top(k)], default=None)) for k in range(len(rows))), key=repr)


def found(df, rows, spark, percent):
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string") if df is None else df, percent=percent)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=repr)


def test_near_duplicates_of_odd_and_edited_texts(spark, monkeypatch):
    rnd = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    rows = [(100, None), (101, ""), (102, " \n\t"), (103, "one two"), (104, "ONE  two\n"), (None, "one two"), (103, "one two")]
    for base in range(4):
        text = [rnd.choice(words) for _ in range(60)]
        for k in range(14):
            text = list(text)
            if k % 3:
                text[rnd.randrange(60)] = rnd.choice(words)  # a chain of edits: ends differ more than neighbours
            rows.append((200 + base * 50 + k, " ".join(text)))
    for percent in (85, 60):
        monkeypatch.setattr(near_dedup, "RIGHT_BLOCK", 5)
        monkeypatch.setattr(near_dedup, "LEFT_BLOCK", 3)
        assert found(None, rows, spark, percent) == brute_components(rows, percent)


@pytest.mark.parametrize("stars", [True, False])
def test_near_duplicates_where_ids_name_several_texts(spark, monkeypatch, stars):
    """Links between texts under one id, also where all buckets are left to blocks."""
    if not stars:
        none = near_dedup.stars
        monkeypatch.setattr(near_dedup, "stars", lambda bands, labels: none(bands, labels).limit(0))
        monkeypatch.setattr(near_dedup, "OPEN", 2)
    monkeypatch.setattr(near_dedup, "RIGHT_BLOCK", 5)
    monkeypatch.setattr(near_dedup, "LEFT_BLOCK", 3)
    rnd, rows = random.Random(4), []
    for base in range(5):
        text = [f"v{rnd.randrange(500)}" for _ in range(80)]
        for k in range(7):
            text = list(text)
            text[rnd.randrange(80)] = f"e{rnd.randrange(500)}"
            rows += [(200 + (base + 3 * k) % 9, " ".join(text))] * (1 + k % 2)
    rows += [(200, None), (200, ""), (None, rows[0][1])]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=85).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute_components(rows, 85)
    firsts = {(r.doc_id, r.text_hash) for r in got if r.is_first and r.n_shingles}
    assert len(firsts) == len(brute_groups(rows, 85))


def test_op6_on_the_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = queries.op6_near_dedup(spark, SF).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute_components(rows, 85)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_nothing(spark):
    assert found(None, [], spark, 80) == []


def test_sketches_merge_and_estimate():
    s, rng = SetSketch(512), np.random.default_rng(0)
    a, b = rng.integers(0, 2**63, 900).astype(np.uint64), rng.integers(0, 2**63, 100).astype(np.uint64)
    ra, rb, rab = s.registers(a), s.registers(b), s.registers(np.concatenate((a, b)))
    assert (np.maximum(ra, rb) == rab).all()
    assert abs((ra == rab).mean() - 0.9) < 0.06
    one = np.array([900]), np.array([1000])
    assert s.may_reach(ra[None], one[0], rab[None], one[1], 0.85)[0]
    assert not s.may_reach(ra[None], one[0], rb[None], np.array([900]), 0.85)[0]


def test_shingles_are_whole_words():
    assert len(shingle_set(normal("a b c d e"))) == 1 and len(shingle_set(normal("a b c d e f"))) == 2
    assert (shingle_set(normal("A  b\nc d e")) == shingle_set(normal("a b c d e"))).all()
    assert len(shingle_set(normal("x " * 100))) == 1


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_line_dedup_drops_recurring_templates_only(spark):
    passage = " ".join(f"p{chr(97 + k % 26)}{'x' * (k // 26)}" for k in range(55))
    log = "request from host took {} ms and returned code {} today"
    own = lambda k: "\n".join(f"only document {'abcdefghij'[k]} says this line {'zyxwvuts'[j]} here" for j in range(8))
    rows = [(k, "\n".join([own(k), passage, log.format(k * 7, k + 200), "short one"])) for k in range(5)]
    rows += [(50 + k, "a copied line with many words\nand another copied line of it") for k in range(4)]
    rows += [(60, None), (61, ""), (None, own(9)), (62, own(8)), (62, own(8))]
    got = defaultdict(list)
    for r in line_dedup.line_dedup(rows_of(spark, rows).withColumn("n_lines", F.lit("clash"))).collect():
        got[r.doc_id].append((r.text, r.n_lines, r.n_dropped))
    assert got[0] == [(rows[0][1], 11, 0)]
    for k in range(1, 5):
        assert got[k] == [(own(k), 11, 3)]  # a short line counts as any other
    for k in range(4):
        assert got[50 + k] == [(rows[5 + k][1], 2, 0)]  # copies of one document are no recurring template
    assert got[60] == [(None, 0, 0)] and got[61] == [("", 1, 0)] and got[None] == [(own(9), 8, 0)] and got[62] == [(own(8), 8, 0)] * 2


def test_line_dedup_generalises_a_variable_end(spark):
    tails = ["alpha beta gamma delta epsilon zeta", "red green blue black white pink", "one two three four five six"]
    rows = [(k, f"this fixed head of a line has {t}\nrest of {'xyz'[k]} {'xyz'[k]} {'xyz'[k]}") for k, t in enumerate(tails)]
    got = {r.doc_id: r.n_dropped for r in line_dedup.line_dedup(rows_of(spark, rows)).collect()}
    assert got == {0: 0, 1: 1, 2: 1}


def test_line_dedup_tells_documents_apart_by_more_than_one_line(spark):
    """Documents that share several lines, short ones too, are different all the same; edited copies are not."""
    rnd = random.Random(7)
    words = lambda n: " ".join("".join(rnd.choices("abdeinorst", k=6)) for _ in range(n))
    shared = [words(8), words(9), words(2), words(3), words(10)]
    rows = [(k, "\n".join([words(40), words(40), *shared])) for k in range(25)]
    base = words(200).split(" ")
    for k in range(6):
        base[k * 30] = words(1)
        rows.append((100 + k, " ".join(base[:150]) + "\n" + " ".join(base[150:]) + "\nthe line that all copies have " + words(1)))
        rows.append((200 + k, "\n".join([" ".join(base[:k * 25]), "this one line is in all copies of it", " ".join(base[k * 25:])])))
    got = {r.doc_id: r for r in line_dedup.line_dedup(rows_of(spark, rows)).collect()}
    assert got[0].text == rows[0][1]
    for k in range(1, 25):
        assert got[k].text == "\n".join(rows[k][1].split("\n")[:2])
    assert all(got[k].n_dropped == 0 for k in got if k >= 100)


def splits(df):
    """How often a row's text is split in the optimized plan of ``df``."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("split(text")


def test_line_dedup_splits_a_text_once(spark):
    """Not in a filter that Spark infers, nor for every line that stays."""
    df = rows_of(spark, [(1, "a\nb\n\nc d\n"), (2, ""), (3, "\n\n"), (4, "one"), (5, "\t\n x \n\r")])
    assert splits(line_dedup.lines_of(df, "doc_id", "text")) == 1
    got = line_dedup.lines_of(df, "doc_id", "text").select("id", "no", "line", "plain").collect()
    assert sorted(map(tuple, got)) == [(1, 0, "a", "a"), (1, 1, "b", "b"), (1, 3, "c d", "c d"), (4, 0, "one", "one"), (5, 1, " x ", "x")]
    gone = F.when(F.col("doc_id") == 3, F.array(F.lit(0), F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1), F.lit(0)))
    df = df.select("doc_id", line_dedup.without_lines(F.col("text"), gone).alias("left"))
    assert splits(df) == 1
    assert {r.doc_id: r.left for r in df.collect()} == {1: "\nc d\n", 2: "", 3: "", 4: "", 5: "\r"}


def test_op4_matches_its_oracle(spark):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = c.sql(f"SELECT doc_id, text, n_lines, n_dropped FROM ({line_dedup.ORACLE})").fetchall()
    assert sorted(map(tuple, queries.op4_line_dedup(spark, SF).select("doc_id", "text", "n_lines", "n_dropped").collect())) == sorted(want)
    assert line_dedup.line_dedup(rows_of(spark, [])).collect() == []


def test_language_id_on_held_out_documents(spark):
    d = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op8_language_id(spark, d).collect()}
    docs = spark.read.parquet(f"{d}/documents.parquet").collect()
    held = [r for r in docs if got[r.doc_id].held_out]
    assert len(got) == len(docs) and len(held) > 150
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in held]) >= 0.97
    assert np.mean([got[r.doc_id].rejected for r in docs]) < 0.01
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_id_of_odd_rows(spark):
    train = [(k, "the cat and the dog are in the house " * 3, "en") for k in range(30)] + [(100 + k, "der hund und die katze sind im haus " * 3, "de") for k in range(30)]
    odd = [(500, None, None), (501, "", "en"), (502, "12 34 !?", "en"), (504, "\u00bd \u00b2 \u2460 \u2167 \u0661", "en"), (505, "der \u00bdhund", None), (None, "der hund und die katze", None), (503, "the dog and the cat " * 20_000, None), (503, "the dog and the cat", None)]
    df = spark.createDataFrame(train + odd, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = language_id.identify(df, language_id.train_profiles(df)).where("doc_id >= 500 or doc_id is null").collect()
    assert sorted((str(r.doc_id), r.lang_pred) for r in got) == sorted([("500", "und"), ("501", "und"), ("502", "und"), ("504", "und"), ("505", "de"), ("None", "de"), ("503", "en"), ("503", "en")])
    assert all(r.rejected for r in got if r.lang_pred == "und")
    none = df.limit(0)
    assert language_id.identify(none, language_id.train_profiles(none)).collect() == []


def edits(a, b):
    """Least edit distance of ``a`` to a run of ``b``."""
    d = [0] * (len(b) + 1)
    for x in a:
        e = [d[0] + 1]
        for j, y in enumerate(b):
            e.append(min(d[j] + (x != y), d[j + 1] + 1, e[-1] + 1))
        d = e
    return min(d)


def test_decontamination_finds_what_the_budget_allows(spark):
    rnd = random.Random(5)
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()][:12] + [(900, None), (901, "ab"), (902, ""), (903, "Of a, b!"), (904, "ab")]
    docs = [(1000, None), (1001, ""), (None, bench[0][1].upper()), (1002, "clean words only " * 3000)]
    for n, (_, text) in enumerate(bench[:12]):
        for share in (0, 0.04, 0.08, 0.3):
            t = list(decontaminate.normal(text))
            for _ in range(int(len(t) * share)):
                p = rnd.randrange(len(t))
                t[p : p + rnd.randrange(2)] = rnd.choice(["", "q", "zz"])
            docs.append((n * 10 + int(share * 100), rnd.choice(["", "before this "]) + "".join(t) + rnd.choice(["", " after that"])))
    docs += docs[-1:] + [(1003, "of a b"), (1004, "xab ab"), (1005, "xab of a bc"), (1006, "AB"), (1007, "of\na.b  ab of a b")]
    # An item at the start of a text whose neighbour before it ends with the item's beginning.
    long = decontaminate.normal(bench[0][1])
    docs += [(1010 + k, f"x {long[: 20 + k]}" if k % 2 == 0 else long[6:] + " tail") for k in range(8)]
    items = [(i, decontaminate.normal(t)) for i, t in bench if t and len(decontaminate.normal(t)) >= decontaminate.Q]
    want = []
    for i, t in docs:
        t = decontaminate.normal(t)
        short = [b for b, x in ((901, "ab"), (903, "of a b"), (904, "ab")) if f" {x} " in f" {t} "]
        want.append((i, sorted(short + [b for b, x in items if edits(x, t) <= decontaminate.budget(len(x), decontaminate.Q, decontaminate.EDITS)[0]])))
    df, b = rows_of(spark, docs).withColumn("found", F.lit(1)), spark.createDataFrame(bench, "item_id long, text string")
    for limit in (decontaminate.BLOCK_BYTES, 600):
        got = decontaminate.contamination(df, b, block_bytes=limit).collect()
        assert sorted(((r.doc_id, sorted({f.item_id for f in r.found})) for r in got), key=repr) == sorted(want, key=repr)
    assert decontaminate.contamination(df, b.limit(0)).where("size(found) > 0").collect() == []
    assert decontaminate.contamination(df.limit(0), b).collect() == []


def test_op10_on_the_table(spark):
    bench = [(r.item_id, decontaminate.normal(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {r.doc_id: set(r.item_ids) for r in queries.op10_decontamination(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        t = decontaminate.normal(r.text)
        assert {i for i, x in bench if x in t} <= got[r.doc_id]


def test_pipeline_stages(spark, tmp_path):
    """Each stage against brute force on its own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append(docs.collect())
    language, lines, near, clean, tokens = kept
    assert all(set(r.asDict()) == {"doc_id", "text", "lang", "source", "n_chars"} for s in kept[:4] for r in s)
    comps = {i: c for i, _, c in brute_components([(r.doc_id, r.text) for r in lines], 80)}
    assert {r.doc_id for r in near} == {i for i, c in comps.items() if i == c}
    bench = [decontaminate.normal(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not [r.doc_id for r in clean if any(x in decontaminate.normal(r.text) for x in bench)]
    assert len(language) >= 195 and {r.doc_id for r in lines} <= {r.doc_id for r in language}
    assert Counter((r.doc_id, r.decoded) for r in tokens) == Counter((r.doc_id, r.text) for r in clean)
    assert bpe.RUN > 0


def test_pipeline_passes_a_text_on_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    own = corpus_pipeline.own_columns(docs)
    assert own.columns == ["doc_id", "text", "_row"] and "text" not in own.schema["_row"].dataType.names
    assert own.select(*corpus_pipeline.row_of(docs)).schema == docs.schema
    profiles = language_id.train_profiles(docs)
    kept = language_id.identify(own, profiles, keep=("text", "_row")).select("doc_id", "text", "lang_pred", "score", "rejected").collect()
    plain = {r.doc_id: r for r in language_id.identify(docs, profiles).collect()}
    assert {r.doc_id: r.text for r in kept} == {r.doc_id: r.text for r in docs.collect()}
    assert all(tuple(plain[r.doc_id]) == (r.doc_id, *r[2:]) for r in kept) and len(kept) == len(plain)
    b = spark.read.parquet(f"{SF}/benchmark.parquet")
    kept = decontaminate.contamination(own, b, keep=("text", "_row")).select("doc_id", "text", "found").collect()
    plain = {r.doc_id: r.found for r in decontaminate.contamination(docs, b).collect()}
    assert {(r.doc_id, r.text) for r in kept} == {(r.doc_id, r.text) for r in docs.collect()}
    assert all(plain[r.doc_id] == r.found for r in kept) and len(kept) == len(plain)


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES])
def test_stages_take_nothing_and_nulls(spark, stage):
    one = spark.createDataFrame([(None, None, None, None, None), (1, "the same text of a few words", "en", "s", 28), (1, "the same text of a few words", "en", "s", 28)], "doc_id long, text string, lang string, source string, n_chars long")
    assert stage(spark, one.limit(0), SF).collect() == []
    assert stage(spark, one, SF).count() <= 3
    clash = one.drop("n_chars").select("*", *[F.lit(7).alias(c) for c in ("n_lines", "n_dropped", "kept", "score", "found", "ids", "_id", "_hash", "text_hash", "row", "id", "c", "t", "component_id")])
    got = stage(spark, clash, SF)
    assert got.columns == clash.columns or stage is corpus_pipeline.token_stage
    assert got.count() <= 3


def test_very_long_texts(spark):
    """Texts of a megabyte, beside short ones, through the stages that compare documents."""
    words = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in range(1000)]
    long = "\n".join(" ".join(words[k : k + 9]) for k in range(0, len(words), 3))
    assert len(long) > 200_000
    rows = [(1, long * 3), (2, long * 3 + " end"), (3, "short text of five words"), (4, long)]
    df = rows_of(spark, rows)
    got = {r.doc_id: (r.text, r.n_dropped) for r in line_dedup.line_dedup(df).collect()}
    assert got[1] == (long * 3, 0) and got[4] == (long, 0) and got[3] == (rows[2][1], 0)
    assert found(df, rows, spark, 85) == brute_components(rows, 85)
    b = spark.createDataFrame([(7, " ".join(words[5000:5040]))], "item_id long, text string")
    assert {r.doc_id: bool(r.found) for r in decontaminate.contamination(df, b).collect()} == {1: False, 2: False, 3: False, 4: False}
    b = spark.createDataFrame([(7, " ".join(words[5001:5010]))], "item_id long, text string")
    assert {r.doc_id: bool(r.found) for r in decontaminate.contamination(df, b).collect()} == {1: True, 2: True, 3: False, 4: True}
