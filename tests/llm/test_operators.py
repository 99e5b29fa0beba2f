"""Operators against brute force, round trips and held-out labels, on small fixtures with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import re
import struct
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from notegraph.llm import bpe, chat, graph, jaccard, lines, lz, packing, pii, quality, queries, secrets, topk

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, row string"
GPT = public_tokenizers.path("byte_bpe_50k.json")
MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and blank texts, a long one, ties, repeated rows, and further columns whose names operators use inside."""
    long = " ".join(f"w{i % 997} x{i % 31}" for i in range(20_000))
    rows = [
        (1, "Hello world, it's  me\n\nagain ", "en", "a/b", 5, 1, "r"), (2, None, None, None, None, None, None), (3, "", "en", "a/b", 0, 3, "r"), (4, " \n\t ", "en", "a/c", 4, 4, "r"),
        (5, long, "en", "a/b", len(long), 5, "r"), (6, "one two", "fr", "b", 7, 6, "r"), (7, "one two", "fr", "b", 7, 6, "r"), (7, "one two", "fr", "b", 7, 6, "r"),
        (None, "no id here at all", "fr", "b", 7, 6, "r"), (9, "émigré 日本語 \U0001f600 \0 ﻿ x y", "fr", "b", 7, 6, "r"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def text_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# --- packing -----------------------------------------------------------------------------------


def check_packed(rows, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(GPT)
    t.encode_special_tokens = True
    want = [(d, [*t.encode(x or "", add_special_tokens=False).ids, 1]) for d, x in docs]
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    for d, ids in want:
        same = [i for e, i in want if e == d]
        if len(same) > 1:
            assert sum(r["length"] for r in by[d]) == sum(map(len, same))
            continue
        at = 0
        for r in sorted(by[d], key=lambda r: r["start"]):
            import zlib

            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{r['length']}I", *ids[at : at + r["length"]]))
            at += r["length"]
        assert at == len(ids)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    padding = 0
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    return padding, sum(r["length"] for r in rows)


def test_packing(spark, sf, odd, none):
    check_packed(packing.pack(odd, GPT).collect(), text_of(odd))
    assert packing.pack(none, GPT).count() == 0
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    padding, total = check_packed(queries.op1_packing(spark, sf).collect(), text_of(docs))
    assert padding < 0.02 * total


def test_packing_maps_added_tokens_as_the_library():
    from tokenizers import Tokenizer

    t, encoder = Tokenizer.from_file(GPT), packing.byte_level_encoder(GPT)
    for text in ("a<|endoftext|>b", "<|endoftext|><|endoftext|>", " <|endoftext|> it's\n\n<|endoftext|", "<|startoftext|> x", "plain"):
        assert encoder.encode(text, allowed_special="all") == t.encode(text, add_special_tokens=False).ids


def test_pack_holds_the_added_token(spark):
    docs = spark.createDataFrame([(1, "a<|endoftext|>b")], "doc_id long, text string")
    assert [r["doc_tokens"] for r in packing.pack(docs, GPT).collect()] == [4]


def test_packing_groups_are_balanced():
    p = packing.Packer(group=4)
    rng = np.random.default_rng(0)
    for i in range(500):
        p.add(i, np.zeros(int(rng.integers(1, 3000)), "<u4"))
    rows = p.flush(True)
    cost = {}
    for r in rows:
        cost[r[9]] = cost.get(r[9], 0) + r[2] ** 2
    most, least = max(cost.values()), sorted(cost.values())[len(cost) // 10]
    assert most < 1.6 * least


# --- BPE ---------------------------------------------------------------------------------------


def tiktoken_of(path):
    import tiktoken

    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})


def test_bpe(spark, odd, none):
    enc = tiktoken_of(MULTI)
    more = spark.createDataFrame([(i, t) for i, t in enumerate(["aaaaaaaaaaaaaaaa", "  \n\n  x", "I'll don't 'sS", "x" * 300, "　 a\x85b\x1c", "١٢٣ ½ ²", "<|endoftext|>", "tab\t\ttab "])], "doc_id long, text string")
    for df in (odd, more, none):
        coded = bpe.encode(df, MULTI)
        got = coded.withColumn("back", bpe.decode(F.col("token_ids"), MULTI)).withColumn("raw", bpe.packed(F.col("token_ids"), 50256)).collect()
        assert len(got) == df.count()
        for r in got:
            ids = enc.encode_ordinary(r["text"] or "")
            assert r["token_ids"] == ids and bytes(r["back"]) == (r["text"] or "").encode() and bytes(r["raw"]) == struct.pack(f"<{len(ids)}I", *ids)


def test_op5_matches_tiktoken(spark, sf):
    """The query itself over a whole table."""
    enc = tiktoken_of(MULTI)
    texts = dict(text_of(spark.read.parquet(f"{sf}/documents.parquet")))
    got = queries.op5_bpe(spark, sf).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        text = texts[r["doc_id"]] or ""
        ids = enc.encode_ordinary(text)
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_every_token_merges_back():
    ranks = bpe.read_ranks(MULTI)
    merges = bpe.Merges(ranks)
    of = lambda a, b: 1 << 30 if (r := merges.rank(a, b)) is None else r
    for token, i in ranks.items():
        ids = [merges.bytes[b] for b in token]
        while len(ids) > 1:
            rank, at = min((of(*pair), k) for k, pair in enumerate(zip(ids, ids[1:], strict=False)))
            assert rank < 1 << 30
            ids[at : at + 2] = [rank]
        assert ids == [i]


def test_fold_throws_nothing(spark):
    """array_position() leaves its loop by an exception, which took most of a step; ties still go to the leftmost pair."""
    assert "array_position" not in str(bpe.fold(F.col("w"), F.col("t"), 50_256))
    enc, merges = tiktoken_of(MULTI), bpe.Merges(bpe.read_ranks(MULTI))
    pieces = ["a", "ab", "aaaaaaa", "abababab", "ananananas", "ß", " Östzu", "😀😀", "0" * 40, "Vraubeenthaaraaraara"]
    words = spark.createDataFrame([(p,) for p in pieces], "w string")
    got = words.select("w", merges.bound(lambda folded: folded(F.col("w"))).alias("ids")).collect()
    assert {r["w"]: r["ids"] for r in got} == {p: enc.encode_ordinary(p) for p in pieces}


def test_bpe_does_not_depend_on_the_cache(odd):
    with_cache = {str(r) for r in bpe.encode(odd, MULTI).select("doc_id", "token_ids").collect()}
    assert with_cache == {str(r) for r in bpe.encode(odd, MULTI, cached_words=1).select("doc_id", "token_ids").collect()}


# --- chat --------------------------------------------------------------------------------------


def test_chat(spark, sf):
    out = {r["conv_id"]: r for r in queries.op3_chat(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/conversations.parquet").orderBy("turn").collect()
    want = {-7: [("user", "\\### Assistant: </turn> ok"), ("assistant", "\\### Assistant: </turn> ok")]}
    for r in rows:
        want.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    assert out.keys() == want.keys()
    for k, turns in want.items():
        said = "".join(t for role, t in turns if role == "assistant")
        r = out[k]
        assert r["n_turns"] == len(turns) and r["loss_chars"] == len(said) and r["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()


def test_chat_parts(spark):
    part = "array<struct<type:string,text:string,ref:string,units:double>>"
    rows = [
        (1, 0, "user", [("text", "a<b#\\", None, None), ("image", None, "i.png", 7841.0), None, ("audio", None, "s.wav", 2.0), ("document", None, "d.pdf", None), ("other", "x", None, None)]),
        (1, 1, None, None), (None, 0, "as:sistant", []), (2, 5, "assistant", [("text", None, None, None)]),
    ]
    turns = chat.format_turns(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {part}"))
    got = {(r["conv_id"], r["turn"]): r for r in turns.collect()}
    first = got[1, 0]
    assert first["formatted"] == "<turn>### user: a\\lb\\h\\b<|image:2|><|audio:3|><|document:4|>x</turn>\n"
    assert [tuple(x) for x in first["attachments"]] == [(2, "image", "i.png", 11), (3, "audio", "s.wav", 50), (4, "document", "d.pdf", 1)]
    assert first["expanded_tokens"] == 2 + 11 + 50 + 1 + 1
    back = {r["conv_id"]: r for r in chat.read_back(turns).collect()}
    assert back[1]["n_turns"] == 2 and back[1]["attachments"] == 3 and back[None]["n_turns"] == 1 and back[2]["loss_chars"] == 0
    assert chat.unescape("\\bl\\l") == "\\l<"
    assert chat.read_back(turns.limit(0)).count() == 0


# --- top-k -------------------------------------------------------------------------------------


def test_topk(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in rng.normal(0, 0.2, 12)]) for i in range(400)]
    vectors += [(400 + i, vectors[50][1]) for i in range(40)] + [(500, None), (501, [None] * 12), (502, [float("nan")] * 12), (503, []), (None, vectors[0][1]), (550, [0.0] * 12), (600, [1.0, 2.0]), (601, [1.0, 3.0])]
    rows = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("v", F.lit("clash"))
    got = {}
    for r in topk.search(rows, rows.filter("vec_id % 50 = 0")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    x = {i: np.floor(256 * np.array(v)) for i, v in vectors if i is not None and v and None not in v and np.isfinite(v).all()}
    assert got.keys() == {i for i in x if i % 50 == 0}
    for q, found in got.items():
        scores = sorted(((-int(x[q] @ v), i) for i, v in x.items() if i != q and len(v) == len(x[q])))[:5]
        assert sorted(found) == [(n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    assert topk.search(rows.limit(0), rows.limit(0)).count() == 0


def test_topk_stops_early():
    rng = np.random.default_rng(0)
    x = np.floor(256 * rng.normal(0, 0.1, (4096, 8)))
    x[7] = np.floor(x[100] * 4)
    ids, scores, read = topk.Lists(np.arange(4096), x).search(x[100], 100, 1)
    assert ids[0] == np.argmax(np.where(np.arange(4096) == 100, -np.inf, x @ x[100])) and read < x.size


# --- fingerprints ------------------------------------------------------------------------------


def test_topk_reads_less_of_more_rows(spark, sf, monkeypatch):
    """The share of list entries that a query reads falls as rows grow, since the first group's best bound all others."""
    monkeypatch.setattr(topk, "GROUP_ROWS", 512)
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    shares = []
    for n in (500, 2000):
        some = rows.filter(F.col("vec_id") < n)
        read = topk.found_by_group(some, some.filter("vec_id % 50 = 0"), k=5, id_col="vec_id", vector_col="embedding", scale=256.0)
        read = read.groupBy("query_id", "entries_read").count().agg(F.sum("entries_read")).first()[0]
        shares.append(read / (some.count() * some.filter("vec_id % 50 = 0").count() * 64))
    assert shares[1] < shares[0] <= 1, shares


def test_topk_of_repeated_ids(spark, monkeypatch):
    """Rows of one id are candidates each, and queries of one id are ranked together; small groups, so that both rounds run."""
    rows = [(i % 7, [float(i), float(-i % 5)]) for i in range(40)] + [(None, [1.0, 2.0]), (8, None), (9, []), (10, [float("nan"), 1.0]), (11, [1.0, 2.0, 3.0])]
    rows = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for size in (16_384, 8):
        monkeypatch.setattr(topk, "GROUP_ROWS", size)
        got = [tuple(r) for r in topk.search(rows, rows.filter("vec_id in (1, 11)"), scale=1.0).orderBy("query_id", "rank").collect()]
        v = [(r["vec_id"], r["embedding"]) for r in rows.collect() if r["vec_id"] is not None and r["embedding"] and all(x == x for x in r["embedding"])]
        pairs = [(-int(sum(a * b for a, b in zip(x, y, strict=True))), j) for i, x in v for j, y in v if i == 1 and j != 1 and len(x) == len(y)]
        assert got == [(1, n + 1, j, -s) for n, (s, j) in enumerate(sorted(pairs)[:5])]


def phrases_slowly(text):
    seen, at = set(), 0
    while at < len(text):
        n = 1
        while at + n <= len(text) and text[at : at + n] in seen:
            n += 1
        seen.add(text[at : at + n])
        at += n
    return seen


def test_lz(spark, sf, odd, none):
    for t in ("", "a", "abababab", "aaaaaaaa", "xyzxyzxyz"):
        assert lz.phrases(t) == phrases_slowly(t)
    docs = sorted(text_of(spark.read.parquet(f"{sf}/documents.parquet")), reverse=True)
    got = {r["doc_id"]: r for r in queries.op7_lz(spark, sf).collect()}
    alone = {r["doc_id"]: r["fingerprint"] for r in lz.fingerprints(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    for (d, t), (n, u) in zip(docs, [*docs[1:], docs[0]], strict=True):
        half = len(t) // 2
        edited = t[: len(t) - half] + u[:half]
        r = got[d]
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and r["n_chars"] == len(t)
        assert r["fingerprint"] == alone[d] and r["edited_fingerprint"] == lz.shown(lz.signature(lz.phrases(edited)))
        a, b = phrases_slowly(t), phrases_slowly(u)
        assert abs(r["near_next"] - len(a & b) / max(1, len(a | b))) < 0.25
    assert lz.compare_neighbours(odd).count() == 10 and lz.compare_neighbours(none).count() == 0
    same = [r["fingerprint"] for r in lz.fingerprints(odd).filter("doc_id in (6, 7)").collect()]
    assert len(set(same)) == 1 and len(same) == 3


# --- secrets -----------------------------------------------------------------------------------


def secrets_slowly(t):
    assign = re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
    found = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(t) if len(m[1]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(found)]


def test_secrets(spark, odd, none):
    live = "aB3" * 8
    texts = [
        "password = 'hunter22' and TOKEN:abcdefg", "x secret=ab secret=token :abcdef", "AKIA" + "A" * 16 + " AKIAB " + "0123456789abcdef" * 2, f"\U0001f600 key {live} api_key: {'f' * 30}", None, "",
        "Example " + "Zz9" * 7, "Example " + "Zz9" * 7, "Example " + "Zz9" * 7,
    ]
    rows = spark.createDataFrame([(i, t, f"o{i}/r") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in secrets.scan(rows).collect()}
    for i, t in enumerate(texts):
        assert [s["shown"] for s in got[i]["base"]] == secrets_slowly(t or "")
        assert set(s["shown"] for s in got[i]["base"]) <= {s["shown"] for s in got[i]["found"]}
    assert any(s["shown"].startswith("opaque") for s in got[3]["found"])
    assert not any(s["shown"].startswith("opaque") for i in (6, 7, 8) for s in got[i]["found"])
    masked = {r["doc_id"]: r["text"] for r in secrets.redact(rows).collect()}
    assert masked[0] == "<secret>' and <secret>" and masked[3].count("<secret>") == 2 and masked[4] is None and masked[6] == texts[6]
    for df in (odd, none):
        assert secrets.scan(df).count() == df.count()
        clean = secrets.redact(df)
        assert clean.columns == df.columns and sorted(map(str, clean.collect())) == sorted(map(str, df.collect()))


def test_secrets_run_no_python(spark, sf):
    plan = queries.op8_secrets(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_secrets_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in queries.op8_secrets(spark, sf).collect()}
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert got.keys() == docs.keys()
    for d, text in docs.items():
        slow = secrets_slowly(text)
        assert [got[d][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(s.startswith(k) for s in slow) for k in ("assign", "access", "hex")]
        assert got[d]["base_sha256"] == hashlib.sha256(",".join(slow).encode()).hexdigest()
        assert set(slow) <= set(filter(None, got[d]["spans"].split(",")))


# --- PII ---------------------------------------------------------------------------------------


def pii_slowly(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    e = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    i = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    c = [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    p = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]
    return {"email": e, "ip": i, "card": c, "phone": p}


def test_pii(spark, odd, none):
    texts = ["a@b.c@d.e f@g .x@y.z-", "1.2.3.4.5.6.7.8 999.1.1.1 0255.1.1.1 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112 0000000000000", "+1 (555) 123-4567 +12 +1((( +49 30 1234567 8", "@@a@b.cc, 12.34.56.78@x.y", "jo [at] ex [dot] com call (030) 123 4567, ssn 123-45-6789"]
    for t in texts:
        assert pii.base_spans(t) == pii_slowly(t)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.detect(rows).collect():
        want = pii_slowly(texts[r["doc_id"]])
        assert r["base"] == ",".join(f"{k}:{a}:{b}" for k, v in want.items() for a, b in v)
        assert set(filter(None, r["base"].split(","))) <= set(r["spans"].split(","))
    assert pii.detect(odd).count() == 10 and pii.detect(none).count() == 0


def test_em_finds_the_reliable_labeler():
    from collections import Counter

    rng = np.random.default_rng(1)
    seen, truth = Counter(), Counter()
    for _ in range(4000):
        y = int(rng.random() < 0.4)
        v = tuple(y if rng.random() < p else 1 - y for p in (0.95, 0.7, 0.7, 0.6))
        seen[v + (0, 0, 0)] += 1
        truth[v + (0, 0, 0)] += y
    q = pii.estimate(seen)
    right = sum(abs((q[k] > 0.5) * n - truth[k]) for k, n in seen.items())
    assert right < 0.15 * 4000


def test_pii_with_many_spans():
    """Added kinds give way to base spans and to kinds before them, as found by comparing all pairs; 20,000 spans in seconds."""
    few = "a@b.com 123-45-6789 a(at)b.org +1 (555) 010 9999 (030) 1234 5678 0123-456-7890 192.168.0.1 DE89370400440532013000 4111 1111 1111 1111 x(at)123-45-6789.com "
    for text in (few, few * 7, "123-45-6789 " * 50):
        held = [s for k in pii.BASE for s in pii.base_spans(text)[k]]
        taken, slow = list(held), []
        for kind, pattern in pii.WIDE:
            for m in pattern.finditer(text):
                if all(m.end() <= x or y <= m.start() for x, y in taken):
                    slow.append((kind, *m.span()))
                    taken.append(m.span())
        assert pii.wide_spans(text, held) == slow and slow
    start = time.monotonic()
    assert len(pii.wide_spans("123-45-6789 x@y.com " * 20_000, [(20 * i + 12, 20 * i + 19) for i in range(20_000)])) == 20_000
    assert time.monotonic() - start < 5


def test_pii_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in queries.op9_pii(spark, sf).collect()}
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert got.keys() == docs.keys()
    for d, text in docs.items():
        slow = pii_slowly(text)
        assert [got[d][f"n_{k}"] for k in pii.BASE] == [len(slow[k]) for k in pii.BASE]
        shown = ",".join(f"{k}:{a}:{b}" for k in pii.BASE for a, b in slow[k])
        assert got[d]["base_sha256"] == hashlib.sha256(shown.encode()).hexdigest()
        assert set(filter(None, shown.split(","))) <= set(got[d]["spans"].split(","))


def test_pii_columns_of_any_name(spark):
    rows = spark.createDataFrame([(1, "mail a@b.com"), (2, None)], "`my.id` long, `a text.x` string")
    assert [(r["doc_id"], r["n_email"]) for r in pii.detect(rows, id_col="my.id", text_col="a text.x").orderBy("doc_id").collect()] == [(1, 1), (2, 0)]


def test_secret_spans_of_many_matches(spark):
    """Matches beyond one fold's block, to their places; 20,000 in seconds."""
    texts = ["", "é" * 3 + " AKIA" + "B" * 20] + ["".join(f"{'x' * (i % 7)} é{i:024x} " for i in range(n)) for n in (1, secrets.FOLD - 1, secrets.FOLD, secrets.FOLD + 1, 5 * secrets.FOLD)] + ["0123456789abcdef01234567 " * 20_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    start = time.monotonic()
    got = {r["i"]: [(s["start"], s["end"], s["value"]) for s in r["s"]] for r in rows.select("i", secrets.spans(F.col("t"), "[0-9a-f]{24,}").alias("s")).collect()}
    assert time.monotonic() - start < 30
    for i, t in enumerate(texts):
        assert got[i] == [(*m.span(), m[0]) for m in re.finditer("[0-9a-f]{24,}", t)]


# --- quality -----------------------------------------------------------------------------------


def test_quality(spark, odd, none):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels.filter(~quality.held_out(F.col("doc_id"))))
    found = quality.score(docs, model).join(labels, "doc_id").filter(quality.held_out(F.col("doc_id"))).select("quality", "quality_score").collect()
    right = [(r["quality_score"] >= 0.3) == (r["quality"] == 1) for r in found]
    assert np.mean(right) > 0.93
    assert np.mean([r["quality_score"] >= 0.3 for r in found if r["quality"] == 1]) > 0.97
    scored = quality.score(odd, model)
    assert scored.columns == [*odd.columns, "quality_score"] and all(0 <= r["quality_score"] <= 1 for r in scored.collect())
    assert quality.score(none, model).count() == 0 and quality.train(none, labels.limit(0)) is None
    text = quality._bytes("word " * 20_000)
    old, quality.CHUNK = quality.CHUNK, 1 << 14
    try:
        parts = model.score(text)
    finally:
        quality.CHUNK = old
    assert abs(parts - model.score(text)) < 0.01


def test_training_reads_every_passage(spark, monkeypatch):
    """Of 100 passages one decides; 32 evenly spaced ones would miss it."""
    passages = [["calm words here ".ljust(quality.PASSAGE, "x")] * 100 for _ in range(2)]
    passages[1][50] = "#!{}" * (quality.PASSAGE // 4)
    texts = spark.createDataFrame([(i, "".join(x)) for i, x in enumerate(passages)], "doc_id long, text string")
    chosen = spark.createDataFrame([(0, 0), (1, 1)], "labelled long, label int")
    rows = {r["label"]: r for r in quality.bags(texts, chosen).collect()}
    seen = {y: np.concatenate(list(quality.unpacked(r["bag"]))) for y, r in rows.items()}
    assert [len(seen[y]) for y in (0, 1)] == [rows[y]["passages"] for y in (0, 1)] == [100, 100]
    assert not np.allclose(seen[0][50], seen[1][50]) and np.allclose(seen[0][2], seen[1][2])


def test_long_bags_train_alike(monkeypatch):
    rng = np.random.default_rng(3)
    found = [rng.random((int(rng.integers(1, 30)), quality.FEATURES)).astype(np.float32) for _ in range(40)]
    bags = [quality.Bag(lambda x=x: [x], len(x), float(rng.integers(0, 2)), 1.0) for x in found]
    whole = quality.descend(lambda f: f(bags), steps=3)
    monkeypatch.setattr(quality, "PASSAGES", 7)
    parts = quality.descend(lambda f: f(bags[:11]) + f(bags[11:]), steps=3)
    assert all(np.allclose(whole.p[k], parts.p[k], atol=1e-3) for k in whole.p)


def test_gradient_of_the_loss():
    rng = np.random.default_rng(5)
    bags = [quality.Bag(lambda x=rng.random((n, quality.FEATURES)).astype(np.float32): [x], n, float(n % 2), 1.0 + n) for n in (1, 4, 9)]
    model = quality.descend(lambda f: f(bags), steps=2)
    flat = quality.gradient(bags, model)

    def loss(key, at, by):
        p = {k: x.astype(np.float64) for k, x in model.p.items()}
        p[key].ravel()[at] += by
        out = 0.0
        for b in bags:
            h, e = quality.Model(model.mean, model.std, p).encode(next(iter(b.parts())).astype(np.float64))
            w = np.exp(e - e.max())
            s = quality._sigmoid(w @ h / w.sum() @ p["c"] + p["d"][0])
            out -= b.weight * np.log(s if b.label else 1 - s)
        return out

    start = 0
    for k, x in model.p.items():
        for i in rng.integers(0, x.size, 4):
            assert abs((loss(k, i, 1e-4) - loss(k, i, -1e-4)) / 2e-4 - flat[start + i]) < 2e-3 * max(1, np.abs(flat[start : start + x.size]).max())
        start += x.size


def test_training_leaves_long_texts_in_tasks(spark, monkeypatch):
    """Documents of 230 passages: what a step sends to the driver has the size of the parameters."""
    texts = spark.createDataFrame([(i, ("calm words here " if i % 2 else "#!{} 99 ") .ljust(quality.PASSAGE, "x") * 230) for i in range(40)], "doc_id long, text string")
    got, real = [], quality._summed

    def watched(sample, share):
        over = real(sample, share)
        return lambda f: (got.append(over(f)), got[-1])[1]

    monkeypatch.setattr(quality, "_summed", watched)
    model = quality.train(texts, spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int"), steps=8)
    assert len(got) == 9 and all(len(x) == sum(v.size for v in model.p.values()) for x in got[1:])
    found = quality.score(texts, model).collect()
    assert min(r["quality_score"] for r in found if r["doc_id"] % 2) > max(r["quality_score"] for r in found if not r["doc_id"] % 2)


def test_quality_query_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries.op6_quality(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert len(got) == docs.count() and all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    held = [(r["quality"], got[r["doc_id"]]["predicted"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if got[r["doc_id"]]["held_out"]]
    assert np.mean([y == p for y, p in held]) > 0.93


# --- Jaccard join ------------------------------------------------------------------------------


def sets_of(rows, width):
    out = []
    for d, t in rows:
        w = (t or "").encode().lower().split()
        out.append((d, frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])))
    return out


def components_slowly(rows, width, num, den):
    sets = sets_of(rows, width)
    comp = {d: d for d, _ in sets}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and den * len(s & t) >= num * len(s | t) and root(a) != root(b):
                comp[max(root(a), root(b))] = min(root(a), root(b))
    return {d: (len(s), root(d)) for d, s in sets}


@pytest.mark.parametrize(("width", "num"), [(3, 90), (5, 80)])
@pytest.mark.parametrize("block", [2048, 16])
def test_jaccard(spark, width, num, block, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = np.random.default_rng(num)
    rows, base = [], [f"w{rng.integers(500)}" for _ in range(150)]
    for i in range(60):
        w = list(base)
        for _ in range(int(rng.integers(0, 9))):
            w[int(rng.integers(len(w)))] = f"n{rng.integers(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(f"v{rng.integers(10**6)}" for _ in range(int(rng.integers(1, 60))))) for i in range(40)]
    rows += [(200, rows[3][1].upper()), (201, "A  b"), (202, "a\tB"), (203, ""), (204, None), (205, " ")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), width=width, num=num).collect()}
    assert got == components_slowly(rows, width, num, 100)


def test_signatures_meet():
    rng = np.random.default_rng(5)
    for num in (80, 90):
        enum = jaccard.Signatures(num, 100)
        for _ in range(300):
            n = int(rng.integers(4, 400))
            s = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            keep = rng.permutation(len(s))[int(rng.integers(0, max(1, len(s) // 8))) :]
            t = np.unique(np.concatenate([s[keep], rng.integers(0, 2**63, int(rng.integers(0, max(1, len(s) // 9)))).astype(np.uint64)]))
            common = len(np.intersect1d(s, t))
            if len(s) != len(t) or common != len(s):
                if 100 * common >= num * (len(s) + len(t) - common):
                    assert len(np.intersect1d(enum(s), enum(t))), (num, len(s), len(t), common)


def test_jaccard_edges(odd, none):
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0, r["n_links"]) for r in jaccard.join(odd).collect())
    assert [g for g in got if g[0] in (6, 7)] == [(6, 6, 2), (7, 6, 2), (7, 6, 2)] and (2, 2, 0) in got and len(got) == 10
    kept = jaccard.drop_near_copies(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 9]
    assert jaccard.join(none).count() == 0


def test_texts_of_one_id(spark):
    """A shared id joins no texts: (5, A) is a copy of 1 and goes, (5, B) is the first of B and stays."""
    a, b, c = ("".join(f"{w}{i} " for i in range(20)) for w in "abc")
    docs = spark.createDataFrame([(1, a), (5, a), (5, b), (7, b), (7, c)], "doc_id long, text string")
    assert sorted(map(tuple, jaccard.drop_near_copies(docs).collect())) == [(1, a), (5, b), (7, c)]
    assert sorted((r["doc_id"], r["component_id"]) for r in jaccard.join(docs).collect()) == [(1, 1), (5, 1), (5, 5), (7, 5), (7, 7)]


def test_components(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (101, 100), (None, 3)]
    got = dict(graph.components(spark.createDataFrame(path, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


# --- lines -------------------------------------------------------------------------------------


def lines_slowly(rows, min_docs=2, similar=0.8, depth=3):
    """drop_recurring by comparing every line with every founder of its leaf, without bands or components."""
    key = lambda line: struct.unpack("<q", struct.pack("<Q", lines.xxhash.xxh3_64_intdigest(line)))[0]
    shown = {}
    for doc, text in rows:
        for at, raw in enumerate((text or "").encode().split(b"\n")):
            tokens = lines.tokens_of(raw)
            if tokens and set(tokens) != {lines.VARIABLE}:
                shown[doc, text, at] = tuple(tokens)
    texts = {}
    for (_, text, _), tokens in shown.items():
        texts.setdefault(tokens, set()).add(text)
    template = {}

    def parse(wanted):
        founders = []
        for t in sorted(wanted, key=lambda t: (-len(texts[t]), key(b" ".join(t)))):
            same = [(sum(x == y for x, y in zip(f, t, strict=True)), -i) for i, f in enumerate(founders) if len(f) == len(t) and f[:depth] == t[:depth]]
            best = max(same, default=(0, 0))
            if not same or best[0] < similar * len(t) - 1e-9:
                founders.append(t)
                best = (len(t), 1 - len(founders))
            yield t, founders[-best[1]]

    parts = {}
    for t in texts:
        parts.setdefault((len(t), t[:depth], part_of(key(b" ".join(t)))), []).append(t)
    for wanted in parts.values():
        template.update(parse(wanted))
    merged = dict(parse({f for t, f in template.items()}))
    template = {t: merged[f] for t, f in template.items()}
    where = {}
    for (doc, text, _), tokens in shown.items():
        where.setdefault(template[tokens], set()).add((text, doc))
    out = []
    for doc, text in rows:
        kept, gone = [], 0
        for at, raw in enumerate((text or "").split("\n")):
            met = where.get(template.get(shown.get((doc, text, at))), ())
            drop = len({t for t, _ in met}) >= min_docs and min(d for _, d in met) != doc
            gone += drop
            kept += [] if drop else [raw]
        out.append((doc, text and "\n".join(kept), gone))
    return out


def part_of(line):
    return PARTS_OF[line]


PARTS_OF = {}


def placed_parts(spark, rows):
    """The first round's part of each distinct line, by Spark's own hash."""
    found = {lines.xxhash.xxh3_64_intdigest(b" ".join(lines.tokens_of(x))) for _, t in rows for x in (t or "").encode().split(b"\n")}
    found = [(struct.unpack("<q", struct.pack("<Q", h))[0],) for h in found]
    PARTS_OF.update(map(tuple, spark.createDataFrame(found, "line long").select("line", F.pmod(F.xxhash64("line"), F.lit(lines.PARTS))).collect()))


def dropped(df, **options):
    return sorted(map(tuple, lines.drop_recurring(df, **options).select("doc_id", "text", "n_dropped").collect()))


@pytest.mark.parametrize("parts", [64, 1])
def test_lines_match_brute_force(spark, parts, monkeypatch):
    """Variants of a few templates, so that leaves, components and both rounds hold many lines."""
    monkeypatch.setattr(lines, "PARTS", parts)
    rng = np.random.default_rng(11)
    word = lambda n: f"{'abcdefghij'[rng.integers(10)]}{'klmnopqrst'[rng.integers(n)]}"
    base = [["log", "line", "of", *(word(10) for _ in range(k))] for k in (0, 1, 2, 7, 9, 17, 30)]

    def line():
        b = list(base[rng.integers(len(base))])
        for _ in range(int(rng.integers(0, 1 + len(b) // 3))):
            b[int(rng.integers(len(b)))] = word(3) if rng.integers(2) else str(rng.integers(99))
        return " ".join(b)

    rows = [(i, "\n".join(line() if rng.integers(3) else " ".join(word(10) for _ in range(8)) for _ in range(int(rng.integers(1, 7))))) for i in range(120)]
    rows += [(500, rows[3][1]), (501, None), (502, ""), (503, "12 34\n12 34"), (504, "12 35\n\n \t\n")]
    placed_parts(spark, rows)
    assert dropped(spark.createDataFrame(rows, "doc_id long, text string")) == sorted(lines_slowly(rows))


def test_op4_matches_brute_force(spark, sf):
    rows = list(map(tuple, spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()))
    placed_parts(spark, rows)
    got = sorted(map(tuple, queries.op4_lines(spark, sf).select("doc_id", "text", "n_dropped").collect()))
    assert got == sorted(lines_slowly(rows)) and sum(n for *_, n in got) > 0


def test_lines(spark, odd, none):
    fill = lambda i: " ".join(f"{w}{'abcdefghij'[i]}" for w in "own words of this document alone".split())
    boiler = "Copyright {} by the authors of this text all rights reserved"
    rows = [(i, f"{fill(i)}\n{boiler.format(2000 + i)}\nshort line\n") for i in range(4)]
    rows += [(10 + i, "the very same text with a line of its own") for i in range(5)] + [(20, "Copyright 1 by the authors of this book all rights reserved")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {d: (t, n) for d, t, n in dropped(df, min_tokens=5)}
    assert got[0] == (rows[0][1], 0)
    for i in range(1, 4):
        assert got[i] == (f"{fill(i)}\nshort line\n", 1)
    assert all(got[10 + i] == (rows[4][1], 0) for i in range(5)) and got[20] == ("", 1)
    assert [t for d, t, _ in dropped(df) if d in (0, 1)] == [rows[0][1], f"{fill(1)}\n"]  # a short line recurs as well
    out = lines.drop_recurring(odd)
    assert out.columns == [*odd.columns, "n_dropped"] and out.drop("n_dropped").exceptAll(odd).count() == 0 and out.count() == 10
    assert lines.drop_recurring(none).count() == 0


def test_lines_of_two_texts_recur(spark):
    passage = " ".join(f"word{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(60))
    rows = [(1, f"a beginning of the first one\n{passage}"), (2, f"{passage}\nand some other end of it"), (3, "five words of its own"), (4, "five words of its own")]
    got = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in lines.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("and some other end of it", 1), 3: (rows[2][1], 0), 4: (rows[3][1], 0)}
    kept = lines.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=3)
    assert kept.agg(F.sum("n_dropped")).first()[0] == 0


@pytest.mark.parametrize("most", [1_000_000, 40, 1])
def test_lines_stay_where_they_are(spark, monkeypatch, most):
    """Leaves and recurring lines meet all lines as one broadcast, in slices, or by a shuffle where they are too many: same rows. A broadcast moves no line."""
    from notegraph.llm import common

    monkeypatch.setattr(common, "BROADCAST_ROWS", most)
    few = common.stored(spark.range(100).select((F.col("id") * 3).alias("leaf")), "few")
    rows = spark.range(400).select((F.col("id") % 200).alias("leaf"), F.col("id").alias("line"))
    got = common.met_with(rows, few, ["leaf"])
    assert sorted(map(tuple, got.collect())) == [(i % 200, i) for i in sorted(range(400), key=lambda i: (i % 200, i)) if i % 200 % 3 == 0]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=broadcast") == {1_000_000: 1, 40: 3, 1: 0}[most]
    text = [(i, f"alpha beta gamma {w} epsilon zeta eta theta\nonly {i} here") for i, w in enumerate("abcabd")]
    made = lines.drop_recurring(spark.createDataFrame(text, "doc_id long, text string"))
    assert sum(r["n_dropped"] for r in made.collect()) > 0 and "SortMergeJoin" not in made._jdf.queryExecution().executedPlan().toString()


def test_lines_pass_clashing_columns(spark):
    rows = [(1, "a line that stands twice\nx", 5, "v", "w"), (2, "a line that stands twice", None, None, "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_dropped int, `a.b` string, line string")
    out = lines.drop_recurring(df, dropped_col=None)
    assert out.columns == df.columns and sorted(map(tuple, out.collect())) == [rows[0], (2, "", None, None, "w")]


def test_leaf_finds_the_most_similar():
    rng = np.random.default_rng(2)
    leaf, founders = lines.Leaf(0.8, 3), []
    for _ in range(300):
        tokens = [b"a", b"b", b"c"] + [b"t%d" % rng.integers(3) for _ in range(7)]
        best = max(((sum(x == y for x, y in zip(f, tokens, strict=True)), -i) for i, f in enumerate(founders)), default=(0, 0))
        want = -best[1] if founders and best[0] >= 8 else len(founders)
        if want == len(founders):
            founders.append(tokens)
        assert leaf.add(tokens) == want


def test_chance_candidates_are_cut_before_their_texts_move(spark, monkeypatch):
    """Documents with a passage in common are candidates of one component; no text is dealt to several blocks for that, and links are those of all pairs."""
    import random

    import numpy as np

    from notegraph.llm import jaccard

    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    passage = [word() for _ in range(60)]
    texts = [" ".join([*passage, *(word() for _ in range(30))]) for _ in range(60)]
    texts += [f"{t} {word()}" for t in texts[:5]] + texts[7:9]
    chosen, stored = [], jaccard.stored

    def kept(df, name, *args):
        done = stored(df, name, *args)
        if name == "chosen":
            chosen.extend(done.collect())
        return done

    monkeypatch.setattr(jaccard, "BLOCK", 16)
    monkeypatch.setattr(jaccard, "SKETCHES", 16)
    monkeypatch.setattr(jaccard, "stored", kept)
    got = {x["doc_id"]: (x["component_id"], x["n_links"]) for x in jaccard.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets = [jaccard.Shingler(5)(t) for t in texts]
    like = lambda a, b: (n := len(np.intersect1d(a, b))) * 180 >= 80 * (len(a) + len(b)) and n > 0
    links = [{j for j, b in enumerate(sets) if i != j and like(a, b)} for i, a in enumerate(sets)]
    assert got == {i: (min([i, *ends]), len(ends)) for i, ends in enumerate(links)} and sum(map(len, links)) == 14
    assert chosen and all(x["blocks"] == 1 for x in chosen)
