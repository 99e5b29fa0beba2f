"""PII spans by weak supervision.

Labelers vote on candidate spans: the shape's own regular expression, a gazetteer of domains' endings, reserved
addresses and bank accounts' countries, and the context around the span. Expectation-maximisation over the counts of all vote patterns of the
corpus estimates each labeler's reliability without gold labels; its posteriors then train
a logistic classifier over the votes and the span's own features. Votes and features are discrete, so
what the driver gathers is one count per pattern, a table whose size the code fixes.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegraph.llm.common import quoted, small_batches

# The kinds in the order in which spans are listed; the base ones first.
BASE = ("email", "ip", "card", "phone")
ADDED = ("email_at", "phone_local", "ssn", "iban")
KINDS = BASE + ADDED

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# Shapes of the added kinds: a wide net, since the votes decide.
WIDE = (
    ("email_at", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[(]dot[\])]) ?[A-Za-z0-9-]{1,63})+", re.I)),
    ("phone_local", re.compile(r"(?<![0-9A-Za-z+.-])(?:\([0-9]{2,4}\) ?|0[0-9]{1,4}[ /-])[0-9]{3,4}(?:[ -]?[0-9]{2,4}){1,2}(?![0-9A-Za-z])")),
    ("ssn", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
)
AT = re.compile(r"[\[(]at[\])]", re.I)
# Gazetteers: endings of domains, countries of bank accounts, and words that stand beside personal data.
ENDINGS = frozenset("com org net edu gov de fr es uk eu io co info".split())
IBAN_COUNTRIES = frozenset("AT BE CH DE DK ES FI FR GB IE IT LU NL NO PL PT SE".split())
CONTEXT = {
    "email": ("mail", "contact", "write", "kontakt", "correo", "courriel"), "ip": ("ip", "host", "server", "address", "login"), "card": ("card", "visa", "pay", "karte", "carte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "ruf"), "ssn": ("ssn", "social", "security"), "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
}
FAMILY = {"email_at": "email", "phone_local": "phone"}
NEAR = 32
LABELERS = ("shape", "gazetteer", "context", "alone")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of a local part, @ and a dotted domain, found from each @, so long runs cost no more than their length."""
    done, at = 0, text.find("@")
    while at >= 0:
        if m := DOMAIN.match(text, at + 1):
            start = at
            while start > done and LOCAL.match(text, start - 1):
                start -= 1
            if start < at:
                yield start, m.end()
                done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The base kinds' spans: leftmost, non-overlapping per kind; a match that fails its test is dropped and not retried."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE}
    if "@" in text:
        out["email"] = list(emails(text))
    for m in IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            out["ip"].append(m.span())
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            out["card"].append(m.span())
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out["phone"].append(m.span())
    return out


def wide_spans(text: str, held: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """Candidates of the added kinds that no base span overlaps; of overlapping ones the first kind's."""
    out: list[tuple[str, int, int]] = []
    taken = merged(held)
    for kind, pattern in WIDE:
        if kind == "email_at" and not AT.search(text):
            continue
        found, at = [], 0
        for m in pattern.finditer(text):
            a, b = m.span()
            while at < len(taken) and taken[at][1] <= a:
                at += 1
            if at == len(taken) or b <= taken[at][0]:
                found.append((a, b))
        out += [(kind, a, b) for a, b in found]
        taken = merged([*taken, *found]) if found else taken
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap as one; a sweep over them and matches in order costs no more than both's number."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def iban_holds(value: str) -> bool:
    v = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def votes(text: str, kind: str, a: int, b: int) -> tuple[int, ...]:
    """Each labeler's vote (1 personal, 0 not, -1 abstains), then the features: kind, and whether a line or parenthesis holds the span alone."""
    value = text[a:b]
    family = FAMILY.get(kind, kind)
    if kind in BASE:
        shape = 1
    elif kind == "iban":
        shape = int(iban_holds(value))
    elif kind == "ssn":
        shape = int(value[:3] not in ("000", "666") and value[0] != "9" and value[4:6] != "00" and value[7:] != "0000")
    else:
        shape = 1 if kind == "email_at" else -1
    if family == "email":
        gazetteer = int(re.split(r"[.\s)\]]", value)[-1].lower() in ENDINGS)
    elif kind == "iban":
        gazetteer = int(value[:2] in IBAN_COUNTRIES)
    elif kind == "ip":
        gazetteer = 0 if value.startswith(("0.", "127.", "255.")) else -1
    else:
        gazetteer = -1
    around = text[max(0, a - NEAR) : a].lower()
    words = set(re.findall(r"[^\W\d_]+", around))
    near = any(w.startswith(c) for w in words for c in CONTEXT[family])
    context = 1 if near else (0 if re.search(r"(?:version|page|section|no|nr|chapter)\.?\s*$", around) else -1)
    left, right = text[a - 1 : a], text[b : b + 1]
    alone = int(not (left.isalnum() or right.isalnum()))
    return shape, gazetteer, context, alone, KINDS.index(kind), int(left in ("", "\n", "(", ":")), min(3, (b - a) // 10)


def estimate(patterns: Counter, rounds: int = 50) -> dict[tuple[int, ...], float]:
    """Posteriors of vote patterns. patterns: count of each; reliabilities are each labeler's chance of voting 1, 0 or nothing given the truth.

    EM starts from the majority of votes; counts are smoothed by one, so an empty corpus gives the priors.
    """
    keys = sorted(patterns)
    n = np.array([patterns[k] for k in keys], dtype=float)
    v = np.array([k[: len(LABELERS)] for k in keys], dtype=int).reshape(-1, len(LABELERS)) + 1
    said = np.where(v == 2, 1.0, np.where(v == 0, -1.0, 0.0)).sum(axis=1)
    q = 1 / (1 + np.exp(-1.5 * said))
    for _ in range(rounds):
        prior = (n @ q + 1) / (n.sum() + 2)
        log = np.log(np.array([1 - prior, prior]))[:, None].repeat(len(keys), 1)
        for j in range(len(LABELERS)):
            for y, w in enumerate((n * (1 - q), n * q)):
                # A labeler is taken to be right more often than wrong: pseudo-counts lean that way.
                lean = np.array([2.0, 1.0, 0.5]) if y == 0 else np.array([0.5, 1.0, 2.0])
                seen = np.bincount(v[:, j], weights=w, minlength=3) + lean
                log[y] += np.log(seen / seen.sum())[v[:, j]]
        log -= log.max(axis=0)
        q = np.exp(log[1]) / np.exp(log).sum(axis=0)
    return dict(zip(keys, q.tolist(), strict=True))


def _design(keys: list[tuple[int, ...]]) -> np.ndarray:
    cols = [np.ones(len(keys))]
    for j in range(len(LABELERS)):
        cols += [np.array([k[j] == 1 for k in keys], float), np.array([k[j] == 0 for k in keys], float)]
    cols += [np.array([k[4] == i for k in keys], float) for i in range(len(KINDS))]
    cols += [np.array([k[5] for k in keys], float)] + [np.array([k[6] == i for k in keys], float) for i in range(4)]
    return np.stack(cols, axis=1)


def train(patterns: Counter, steps: int = 300) -> dict[tuple[int, ...], float]:
    """The final classifier's probability for each pattern: logistic regression on EM's posteriors, weighted by counts, with a ridge."""
    if not patterns:
        return {}
    soft = estimate(patterns)
    keys = sorted(patterns)
    x, y = _design(keys), np.array([soft[k] for k in keys])
    n = np.array([patterns[k] for k in keys], float)
    w = np.zeros(x.shape[1])
    for _ in range(min(steps, 30)):  # Newton's steps
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * (p - y)) + 0.1 * w
        hess = (x * (n * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w -= np.linalg.solve(hess, grad)
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return dict(zip(keys, p.tolist(), strict=True))


def _candidates(text: str) -> list[tuple[str, int, int]]:
    base = base_spans(text)
    held = [(k, a, b) for k in BASE for a, b in base[k]]
    return held + wide_spans(text, [(a, b) for _, a, b in held])


def count_patterns(docs: DataFrame, text_col: str = "text") -> Counter:
    """Counts of the vote patterns over the whole corpus; summed per task before they are shuffled."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    c.update(votes(text, *s) for s in _candidates(text))
        yield pa.RecordBatch.from_arrays([pa.array([",".join(map(str, k)) for k in c], pa.string()), pa.array(list(c.values()), pa.int64())], ["pattern", "n"])

    found = docs.select(F.col(quoted(text_col)).cast("string").alias("text")).mapInArrow(run, "pattern string, n long")
    return Counter({tuple(map(int, r["pattern"].split(","))): r["n"] for r in found.groupBy("pattern").agg(F.sum("n").alias("n")).collect()})


RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string, scores array<double>"


def detect(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Spans of personal data: one row a document, base and spans as kind:start:end joined by commas, by kind as listed, then start; scores gives the classifier's probability of each span.

    Base spans stay whatever the classifier says; added kinds stay at threshold or above. Null or empty text: no
    spans. Two passes over the texts: one counts vote patterns, one applies the classifier. Nothing
    but pattern counts is shuffled. Repeated rows, null ids and further columns do no harm.
    """
    model = train(count_patterns(docs, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = [(KINDS.index(k), a, b, model.get(votes(text, k, a, b), 0.0)) for k, a, b in _candidates(text or "")]
                shown = lambda s: ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b, _ in s)
                base = sorted(s for s in found if s[0] < len(BASE))
                kept = sorted(s for s in found if s[0] < len(BASE) or s[3] >= threshold)
                rows.append((doc_id, *(sum(s[0] == i for s in base) for i in range(len(BASE))), shown(base), shown(kept), [s[3] for s in kept]))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 5 + [pa.string()] * 2 + [pa.list_(pa.float64())], strict=True)], [x.split()[0] for x in RESULT.split(", ")])

    return docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).cast("string").alias("text")).mapInArrow(run, RESULT)
