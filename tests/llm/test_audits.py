"""The filter audit, the quality rules and the source divergence against brute force, on rows with nulls, empty and long texts, ties, repeats and clashing names."""

import itertools
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from notegraph.llm import audit, divergence, queries, rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, t string, id long, part string, row string, `a.b` string"
LONG = " ".join(f"w{i % 997} x{i % 31}" for i in range(20_000))
PROSE = " ".join(f"word{i} Another thing{i % 7}" for i in range(40))
TEXTS = [None, "", " \n\t ", "one two", "One TWO three # four", PROSE, PROSE, PROSE + " ", PROSE[:70] + "z" + PROSE[71:], LONG, LONG + "x", LONG, "a b c d e a b c d e a b c d e f g h", "same line\nsame line\n\nsame line\nother", "émigré 日本語 \U0001f600 x y É", "A" * 60]


def rows():
    out = []
    for i, text in enumerate(TEXTS * 2):
        out.append((i, text, [None, "", "en", "fr"][i % 4], [None, "", "s", "r", "s"][i % 5], "t", 7, "p", "r", "ab"))
    out += [out[5], out[5], (None, PROSE, "en", "s", None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return out


LABELS = [(0, 1, 0), (5, 1, 1), (5, 0, 0), (6, None, 1), (9, 0, 1), (None, 1, 1), (21, 1, 0), (999, 1, 1)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def audited(data, labels):
    least, facts = {}, []
    for r in data:
        if r[0] is not None:
            least[r[1] or ""] = min(r[0], least.get(r[1] or "", r[0]))
    good, toxic = ({d for d, *v in labels if d is not None and v[i] == 1} for i in (0, 1))
    for r in data:
        t, w = r[1] or "", WORD.findall(r[1] or "")
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": r[0] is not None and least[t] < r[0]}
        facts.append((r[3] or "", {k for k, v in fails.items() if v}, r[0] in good, r[0] in toxic))
    out = {}
    for part in {f[0] for f in facts}:
        removed = Counter()
        own = [f for f in facts if f[0] == part]
        for order in itertools.permutations("ABCDE"):
            for step, x in enumerate(order, 1):
                before = set(order[: step - 1])
                here = [f for f in own if x in f[1] and not f[1] & before]
                removed[x] += len(here)
                out[part, "".join(order), step] = [sum(not f[1] & (before | {x}) for f in own), len(here), sum(x in f[1] and bool(f[1] & before) for f in own), sum(f[1] == {x} for f in own), sum(f[2] for f in here), sum(f[3] for f in here)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(removed[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_audit(spark, odd, labels):
    got = {(r[0], r[1], r[2]): tuple(r)[3:] for r in audit.audit(odd, labels).collect()}
    assert got == audited(rows(), LABELS) and len(got) == 3 * 600


def test_audit_without_rows(spark, odd, labels):
    assert audit.audit(odd.limit(0), labels).count() == 0
    assert audit.audit(odd, labels.limit(0)).agg(F.sum("good_lost"), F.sum("toxic_lost")).first()[:] == (0, 0)


def test_audit_tries_other_hashes_when_texts_of_one_key_differ(spark, odd, labels, monkeypatch):
    """Levels that hash nothing but the length put texts of one length together; only the comparison of whole texts can tell them apart."""
    plain, seeds = audit._levels, []

    def levels(text, seed):
        seeds.append(seed)
        return plain(F.lit("x").cast("string") if seed == 0 else text, seed)

    monkeypatch.setattr(audit, "_levels", levels)
    got = {(r[0], r[1], r[2]): tuple(r)[3:] for r in audit.audit(odd, labels).collect()}
    assert got == audited(rows(), LABELS) and 1 in seeds


def counted(text):
    text, w = text or "", WORD.findall(text or "")
    places = defaultdict(list)
    for i in range(len(w) - 4):
        places[tuple(w[i : i + 5])].append(i)
    covered = {i + k for p in places.values() if len(p) > 1 for i in p for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_rules_count(spark, odd, labels):
    found = rules.judge(odd.withColumn("text", F.col("text")), rules.Model(None, None))
    for r in odd.select("doc_id", "text").join(found, "doc_id").collect():
        assert tuple(r[c] for c in BASE) == counted(r["text"]) and r["kept"] == (not r["base_failed"])
    assert found.count() == len(rows()) and rules.judge(odd.limit(0), rules.Model(None, None)).count() == 0


def test_rules_keep_all_columns(spark, odd):
    kept = rules.keep(odd, rules.Model(None, None))
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == sorted(r[0] or -1 for r in rows() if not counted(r[1])[5])


def test_rules_without_labels_or_rows(spark, odd, labels):
    assert rules.fit(odd, labels.limit(0)) == rules.Model(None, None)
    assert rules.fit(odd.limit(0), labels) == rules.Model(None, None)
    assert rules.fit(odd, labels.withColumn("quality", F.lit(0))) == rules.Model(None, None)


def test_rules_ratio_is_the_multinomials(spark):
    """Scores from counts in plain Python over the same buckets."""
    import math

    docs = [(i, " ".join(["good", "fine", f"n{i % 3}"] * 5) if i % 2 else " ".join(["bad!!", "worse!!", f"n{i % 3}"] * 5)) for i in range(200)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    model = rules.fit(frame, labels)
    grams = lambda t: [(w,) for w in t.split()] + list(zip(t.split(), t.split()[1:]))
    distinct = sorted({g for _, t in docs for g in grams(t)})
    of = {g: spark.range(1).select(rules._bucket(*(F.lit(w) for w in g))).first()[0] for g in distinct}
    corpus, trusted = (Counter(of[g] for i, t in docs if keep(i) for g in grams(t)) for keep in (lambda i: True, lambda i: i % 2 and zlib.crc32(str(i).encode()) % 5 > 1))
    n, t = sum(corpus.values()), sum(trusted.values())
    for b in of.values():
        want = math.log((trusted[b] + 1) / (t + rules.BUCKETS)) - math.log((corpus[b] + 1) / (n + rules.BUCKETS))
        assert model.ratios[b] == round(want * rules.UNIT)
    scores = {r["doc_id"]: r["score"] for r in rules.judge(frame, model).collect()}
    for i, text in docs:
        assert scores[i] == pytest.approx(sum(model.ratios[of[g]] for g in grams(text)) / len(grams(text)) / rules.UNIT)
    assert min(scores[i] for i in range(1, 200, 2)) > max(scores[i] for i in range(0, 200, 2))


def test_rules_query_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries.op12_quality_rules(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        assert tuple(got[r["doc_id"]][c] for c in BASE) == counted(r["text"])
    held = [(r["quality"], got[r["doc_id"]]["kept"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    good, bad = ([k for q, k in held if q == y] for y in (1, 0))
    assert sum(good) > 0.9 * len(good) and sum(bad) < 0.1 * len(bad)


def test_rules_plan_has_no_python(spark, sf):
    plan = queries.op12_quality_rules(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def diverged(data, least):
    docs = [(r[2] or "", r[3] or "", Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (r[1] or "").translate({c: c + 32 for c in range(65, 91)})))) for r in data]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        seen = Counter(t for d in own for t in d[2])
        kept, sources = sorted(t for t in seen if seen[t] >= least), sorted({d[1] for d in own})
        n = {s: sum((d[2] for d in own if d[1] == s), Counter()) for s in sources}
        whole = sum(n.values(), Counter())
        share = lambda c, v=len(kept): {t: 1 + 1_000_000_000 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * v) for t in kept}
        p, q = {s: share(n[s]) for s in sources}, share(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s)
            terms = sorted((-f(p[s][t], q[t]), t.encode(), t) for t in kept if n[s][t] > 0 and p[s][t] > q[t])[:10]
            out |= {(lang, s, "pair", o, -v, i) for i, (v, o) in enumerate(pairs, 1)} | {(lang, s, "term", t, -v, i) for i, (v, _, t) in enumerate(terms, 1)}
    return out


@pytest.mark.parametrize("least", [1, 2, 10, 1000])
def test_divergence(spark, odd, least):
    """Also where no term is kept, and with tasks that hand on what they hold at once."""
    got = [tuple(r) for r in divergence.audit(odd, least_docs=least, held=3 if least == 2 else divergence.HELD).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got)) and set(got) == diverged(rows(), least)


def test_divergence_without_rows(spark, odd):
    assert divergence.audit(odd.limit(0)).count() == 0


def test_rules_learn_from_all_labels(spark):
    """More labelled documents than any sample held: the counts are those of all outside the remainders 0 and 1."""
    import math

    n = 90_000
    frame = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("good").alias("text"))
    model = rules.fit(frame, frame.select("doc_id", F.lit(1).alias("quality")))
    t = sum(zlib.crc32(str(i).encode()) % 5 > 1 for i in range(n))
    bucket = spark.range(1).select(rules._bucket(F.lit("good"))).first()[0]
    assert model.ratios[bucket] == round(rules.UNIT * (math.log((t + 1) / (t + rules.BUCKETS)) - math.log((n + 1) / (n + rules.BUCKETS))))


@pytest.mark.parametrize("n", [1, 2, 399, 401, 1000])
def test_rules_threshold_is_the_percentile(spark, n):
    scores = spark.range(n).select(F.rand(n).alias("score"))
    assert rules._share(scores, 0.0025) == pytest.approx(scores.agg(F.percentile("score", F.lit(0.0025))).first()[0], abs=1e-12)
