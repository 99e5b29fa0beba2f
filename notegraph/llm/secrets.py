"""Secret scans by corpus-wide ownership frequency, in DataFrame functions only.

Spans come from a regular expression's gaps and matches. Candidate values are hashed and counted by
distinct repositories and owners over the whole corpus: a value that many owners hold is a
copied example, one that few hold is live-looking.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notegraph.llm.common import let, quoted, stored

# The patterns of the base kinds, in the order in which spans are listed.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Tokens that hold lower case, upper case and digits; long runs without one of them are words, numbers or hashes.
OPAQUE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+"

#: As spans of one start are listed; the last is the kind that ownership adds.
KINDS = ("assign", "access", "hex", "opaque")
#: Matches that are folded at a time: an accumulator is copied at each step, so one of all matches would cost their square.
FOLD = 128
SPAN = "struct<start:bigint,end:bigint,value:string>"


@dataclass(frozen=True)
class Ownership:
    """A candidate of at most max_owners owners and max_repos repositories looks live; others are widely copied examples."""

    max_owners: int = 2
    max_repos: int = 2


def spans(text: Column, pattern: str, group: int = 0) -> Column:
    """Leftmost non-overlapping matches as array of (start, end, value): code points, end exclusive; value is the group's.

    The gaps between matches and the matches themselves come from the same scan, so their lengths add up to places.
    A text without a match isn't split.
    """
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    steps = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("match"), values.alias("value"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / FOLD).cast("int")), lambda i: F.slice(steps, i * FOLD + 1, FOLD))
    none = F.array().cast(f"array<{SPAN}>")
    first = lambda at, empty: F.struct(at.cast("long").alias("at"), empty.alias("out"))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["gap"])
        end = start + F.char_length(x["match"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value")))).alias("out")).cast(f"struct<at:bigint,out:array<{SPAN}>>")

    def add_block(acc: Column, block: Column) -> Column:
        inner = F.aggregate(block, first(acc["at"], none), add)
        return let(inner, lambda b: F.struct(b["at"].alias("at"), F.concat(acc["out"], F.array(b["out"])).alias("out"))).cast(f"struct<at:bigint,out:array<array<{SPAN}>>>")

    folded = F.aggregate(blocks, first(F.lit(0), F.array().cast(f"array<array<{SPAN}>>")), add_block, lambda a: F.flatten(a["out"]))
    return F.when(text.rlike(pattern), folded).otherwise(none)


def _listed(found: Column, kind: str) -> Column:
    """Spans as structs that sort by start, then by kind as listed, and print as kind:start:end."""
    order = KINDS.index(kind)
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("k"), F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")).alias("shown"), s["end"].alias("end"), s["value"].alias("value")))


def _candidates(docs: DataFrame, id_col: str, text_col: str, repo_col: str) -> DataFrame:
    """Per row: doc_id, key (hash of id and text), repo, the base kinds' counts, base and extra span structs. No shuffle."""
    text = F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit(""))
    repo = F.coalesce(F.col(quoted(repo_col)).cast("string"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), F.col(quoted(id_col)).cast("long").alias("doc_id"), text.alias("t"), repo.alias("repo"))
    t = F.col("t")
    kept = F.filter(spans(t, ASSIGN, 1), lambda s: F.char_length(s["value"]) >= 6)
    base = rows.select("row", "doc_id", F.xxhash64("doc_id", "t").alias("key"), "repo", kept.alias("assign"), spans(t, ACCESS).alias("access"), spans(t, HEX).alias("hex"), spans(t, OPAQUE).alias("opaque"))
    mixed = F.filter("opaque", lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[a-z]") & s["value"].rlike("[A-Z]"))
    held = F.concat("assign", "access", "hex")
    free = F.filter(mixed, lambda s: ~F.exists(held, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return base.select(
        "row", "doc_id", "key", "repo",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.array_sort(F.concat(*(_listed(F.col(k), k) for k in ("assign", "access", "hex")))).alias("base"),
        _listed(free, "opaque").alias("extra"),
    )


def _judged(listed: DataFrame, ownership: Ownership) -> DataFrame:
    """Per id and key of rows with candidates: the live and the copied span structs.

    Values are counted with map-side combining by (hash, owner, repository) and then by hash, so one which a
    third of the rows hold is a few rows per task; the join back is one that AQE can split.
    """
    every = listed.select("doc_id", "key", "repo", F.explode(F.concat("base", "extra")).alias("s")).withColumn("hash", F.xxhash64("s.value"))
    counts = every.groupBy("hash", F.substring_index("repo", "/", 1).alias("owner"), "repo").agg(F.lit(1).alias("one"))
    counts = counts.groupBy("hash", "owner").agg(F.count("*").alias("repos")).groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))
    verdict = counts.select("hash", ((F.col("owners") <= ownership.max_owners) & (F.col("repos") <= ownership.max_repos)).alias("live"))
    judged = every.select("doc_id", "key", "hash", "s").join(verdict, "hash")
    sets = judged.groupBy("doc_id", "key").agg(F.collect_set(F.when(F.col("live"), F.col("s"))).alias("live"), F.collect_set(F.when(~F.col("live"), F.col("s"))).alias("copied"))
    return sets.select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "live", "copied")


def _same() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k"))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source", ownership: Ownership | None = None) -> DataFrame:
    """One row a document: doc_id, n_assign, n_access, n_hex, base and found (span structs by start, then kind), and n_live and n_copied (candidates by ownership).

    The base kinds hold always. Opaque tokens (20 characters or more, of three classes) outside
    base spans are added where the corpus shows them to be owner-specific. An owner is what precedes the first slash of a
    repository, or the whole of it; a null repository is one of its own. Null text: no spans. Rows alike
    in id and text get the same spans; an id may be null. No rows: none.
    """
    listed = stored(_candidates(docs, id_col, text_col, repo_col).drop("row"), "secrets")
    whole = listed.join(_judged(listed, ownership or Ownership()), _same(), "left")
    none = F.slice("base", 1, 0)
    added = F.filter(F.coalesce("live", none), lambda s: s["k"] == len(KINDS) - 1)
    return whole.select(
        "doc_id", "n_assign", "n_access", "n_hex", "base", F.array_sort(F.concat("base", added)).alias("found"),
        F.size(F.coalesce("live", none)).cast("long").alias("n_live"), F.size(F.coalesce("copied", none)).cast("long").alias("n_copied"),
    )


def redact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source", ownership: Ownership | None = None, live_mask: str = "<secret>", copied_mask: str = "<example-secret>") -> DataFrame:
    """docs with each found secret's span replaced in text_col: live-looking ones by live_mask, copied base ones by copied_mask.

    Rows without candidates pass unchanged and unshuffled. Of overlapping spans the later is cut to what the earlier leaves; a live span's mask
    stands where both begin alike. All rows and columns stay; edge cases are as in scan().
    """
    found = _candidates(docs, id_col, text_col, repo_col)
    some = (F.size("base") > 0) | (F.size("extra") > 0)
    judged = _judged(stored(found.filter(some).drop("row"), "secrets"), ownership or Ownership())
    marked = found.filter(some).join(judged, _same(), "left")
    opaque = len(KINDS) - 1
    none = F.slice("base", 1, 0)
    cut = lambda spans_, mask: F.transform(spans_, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(mask).alias("mask")))
    masks = F.concat(cut(F.coalesce("live", none), live_mask), cut(F.filter(F.coalesce("copied", none), lambda s: s["k"] != opaque), copied_mask))
    text = F.col(f"row.{quoted(text_col)}")

    def add(acc: Column, s: Column) -> Column:
        fresh = s["end"] > acc["at"]
        part = F.array(F.substr(text, (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int")), s["mask"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], part)).otherwise(acc["out"]).alias("out"))

    first = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
    masked = F.aggregate(F.array_sort(masks), first, add, lambda a: F.concat(F.array_join(a["out"], ""), F.substr(text, (a["at"] + 1).cast("int"))))
    changed = marked.select(F.col("row").withField(quoted(text_col), F.when(F.size(masks) > 0, masked).otherwise(text)).alias("row"))
    return found.filter(~some).select("row.*").unionByName(changed.select("row.*"))
