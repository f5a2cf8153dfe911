"""Operator 9: personal data by patterns, and terms that reveal it by their co-occurrence."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.llm.stage import discard, free_names, numbered, table, types_of

#: Base kinds in their fixed order.
KINDS = ("email", "ip", "card", "phone")
#: What the method adds: values that are assigned to the name of a secret, and disclosing terms.
SECRET, TERM = "secret", "term"
#: Terms on each side of a match or term that count as its context; distinct contexts that a pair of term and
#: entity needs; share of an entity's information that a term may disclose; most terms to broadcast.
REACH, CONTEXTS, DISCLOSED, BROADCAST = 4, 3, 0.95, 200_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Numbers with single dots between them; every four of them, from the first on, are an address.
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: A secret: its name, a colon or equals sign, and a value with a letter and a digit, in quotes or not.
_ASSIGNS = re.compile("[:=]")
_NAME = re.compile(r"(?:secret|token|password|passwd|pwd|(?:api|access|private)[_-]?key)[\"']?[\x20\t]{0,4}\Z", re.IGNORECASE)
_BEFORE, _VALUE, _VALUED = re.compile(r"[\x20\t]{0,4}[\"']?"), re.compile(r"[^\s\"'<>,;]*"), 8
_NAMED = 24
_DIGIT, _LETTER = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")
_TERM = re.compile(r"[^\W\d_]{3,}")
_ASIDE = 200


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from each ``@``, in time in proportion to the text."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            free = found.end()
            yield start, free
        at = text.find("@", max(at + 1, free))


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping groups of four numbers with dots between them, each at most 255."""
    for m in _DOTTED.finditer(text):
        parts = m[0].split(".")
        at = m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in four)):
                yield at, end
            at = end + 1


def matches(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base kinds, by start, then kind as listed."""
    out = [(s, e, 0) for s, e in emails(text)]
    if _DIGIT.search(text):
        out += [(s, e, 1) for s, e in addresses(text)]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), 2))
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), m.end(), 3))
    return [(s, e, KINDS[k]) for s, e, k in sorted(out, key=lambda x: (x[0], x[2], x[1]))]


def secrets(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of assigned secrets, by start; they may overlap matches of the base kinds.

    Many names may stand before one long value that is none; its end, and the next digit and letter, are
    looked up once for all of them.
    """
    out, free, end = [], 0, 0
    has = {_DIGIT: -1, _LETTER: -1}
    for m in _ASSIGNS.finditer(text):
        at = m.start()
        if at >= free and _NAME.search(text, max(free, at - _NAMED), at):
            start = _BEFORE.match(text, at + 1).end()
            if start >= end:
                end = _VALUE.match(text, start).end()
            for kind, known in has.items():
                if known < start:
                    found = kind.search(text, start, end)
                    has[kind] = found.start() if found else end
            if end - start >= _VALUED and max(has.values()) < end:
                free = end
                out.append((start, end, SECRET))
    return out


def protected(text: str) -> list[tuple[int, int, str]]:
    """All that names a protected entity in a text: matches of the base kinds and secrets, by start."""
    return sorted(matches(text) + secrets(text), key=lambda x: x[0])


def entity(kind: str, value: str) -> str:
    """The protected entity that a match names: lower-case address, or digits only."""
    if kind == SECRET:
        return f"{kind}:{value}"
    return f"{kind}:{value.lower()}" if kind in ("email", "ip") else f"{kind}:{''.join(c for c in value if c.isdigit())}"


def contexts(text: str, found: list[tuple[int, int, str]], terms: list[tuple[str, int, int]]) -> dict[str, dict[str, set[str]]]:
    """Of each entity matched in the text, the hashes of the contexts of each of ``terms`` (those outside all matches) near a match."""
    out: dict[str, dict[str, set[str]]] = {}
    starts = [s for _, s, _ in terms]
    for s, e, kind in found:
        i, j = bisect_left(starts, s), bisect_left(starts, e)
        before = [t for t, at, _ in terms[max(0, i - REACH) : i] if at >= s - _ASIDE]
        near = before + [t for t, _, end in terms[j : j + REACH] if end <= e + _ASIDE]
        own = out.setdefault(entity(kind, text[s:e]), {})
        for term in near:
            own.setdefault(term, set()).add(_mark(near))
    return out


def _mark(words: list[str]) -> str:
    return hashlib.md5(" ".join(words).encode()).hexdigest()[:16]


def outside(text: str, found: list[tuple[int, int, str]]) -> list[tuple[str, int, int]]:
    """(term, start, end) of all terms outside all matches, by start."""
    out, k, end = [], 0, 0
    for m in _TERM.finditer(text):
        while k < len(found) and found[k][0] < m.end():
            end = max(end, found[k][1])
            k += 1
        if end <= m.start():
            out.append((m[0].lower(), m.start(), m.end()))
    return out


def together(text: str, found: list[tuple[int, int, str]], wanted: set[str]) -> Iterator[tuple[str, str, str, int]]:
    """(term, entity, hash of a context, 1 for the pair's first context or 0) of all terms with the wanted entities.

    The context of a term that stands near a match is that of the match, of another term its own first one.
    """
    free = outside(text, found)
    near = {name: own for name, own in contexts(text, found, free).items() if name in wanted}
    if not near:
        return
    terms = [t for t, _, _ in free]
    first: dict[str, int] = {}
    for k, t in enumerate(terms):
        first.setdefault(t, k)
    for t, k in first.items():
        own = ""
        for name, beside in near.items():
            if t in beside:
                marks = sorted(beside[t])
            else:
                own = own or _mark(terms[max(0, k - REACH) : k + REACH + 1])
                marks = [own]
            for n, mark in enumerate(marks):
                yield t, name, mark, int(n == 0)


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{s}:{e}" for s, e, kind in spans)


def entities_of(rows: DataFrame) -> DataFrame:
    """(entity, n_entity, n_matches): the rows of ``rows(text)`` with each entity, and its matches there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got: Counter[str] = Counter()
            for text in batch.column(0).to_pylist():
                own = Counter(entity(kind, text[s:e]) for s, e, kind in protected(text)) if text else {}
                for name, n in own.items():
                    got[name] += (1 << 32) + n
            cols = [list(got), [n >> 32 for n in got.values()], [n & 0xFFFFFFFF for n in got.values()]]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *[pa.array(c, pa.int64()) for c in cols[1:]]], ["entity", "n", "m"])

    found = rows.select("text").mapInArrow(run, "entity string, n long, m long")
    return found.groupBy("entity").agg(F.sum("n").alias("n_entity"), F.sum("m").alias("n_matches"))


def pairs_of(rows: DataFrame, wanted: frozenset[str] | None) -> DataFrame:
    """(term, entity, n_both, n_marks): rows of ``rows(text)`` with both, and their contexts; entities all or ``wanted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64())
        out: list[tuple] = []

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], ["term", "entity", "mark", "first"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = protected(text) if text else []
                names = {entity(kind, text[s:e]) for s, e, kind in found}
                for x in together(text, found, names if wanted is None else names & wanted) if names else ():
                    out.append(x)
                    if len(out) >= 1 << 15:
                        yield full()
                        out.clear()
        yield full()

    met = rows.select("text").mapInArrow(run, "term string, entity string, mark string, first long")
    met = met.groupBy("term", "entity", "mark").agg(F.sum("first").alias("n"))
    return met.groupBy("term", "entity").agg(F.sum("n").alias("n_both"), F.count(F.lit(1)).alias("n_marks"))


def occurrences(rows: DataFrame, telling: DataFrame) -> DataFrame:
    """(row, more): the places of the terms of ``telling(term)`` in ``rows(row, text)``, for more terms than a task should hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = outside(text, protected(text)) if text else []
                cols = [pa.array([row] * len(own), pa.int64()), pa.array([x[0] for x in own], pa.string())]
                cols += [pa.array([x[k] for x in own], pa.int32()) for k in (1, 2)]
                yield pa.RecordBatch.from_arrays(cols, ["row", "term", "s", "e"])

    places = rows.select("row", "text").mapInArrow(run, "row long, term string, s int, e int").join(telling, "term", "left_semi")
    return places.groupBy("row").agg(F.collect_list(F.struct("s", "e")).alias("more"))


def spans_of(rows: DataFrame, terms: frozenset[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns of private_spans of ``rows(doc_id, text, more)`` and ``keep``; ``more`` holds places of terms beside those in ``terms``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, base, spans = [], [], []
            for text, more in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                found = matches(text or "")
                base.append(hashlib.sha256(written(found).encode()).hexdigest())
                found += secrets(text or "")
                found.sort(key=lambda x: x[0])
                own = [(s, e, TERM) for t, s, e in outside(text, found) if t in terms] if text and terms else []
                own += [(x["s"], x["e"], TERM) for x in more or ()]
                counts.append([sum(k == kind for _, _, k in found) for kind in counted[:-1]] + [len(own)])
                spans.append(written(sorted(found + own, key=lambda x: x[0])))
            cols = [batch.column(0)] + [pa.array([c[k] for c in counts], pa.int64()) for k in range(len(counted))]
            cols += [pa.array(base, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays([*cols, *(batch.column(3 + k) for k in range(len(keep)))], names)

    counted = [*KINDS, SECRET, TERM]
    names = ["doc_id", *(f"n_{k}" for k in counted), "base_sha256", "spans", *keep]
    schema = ["doc_id long", *(f"n_{k} long" for k in counted), "base_sha256 string, spans string", *types_of(rows, keep)]
    return rows.select("doc_id", "text", "more", *keep).mapInArrow(run, ", ".join(schema))


def term_counts(rows: DataFrame, wanted: DataFrame, n_wanted: int) -> DataFrame:
    """(term, n_term): the documents that hold each term of ``wanted(term)``, over all of ``rows(text)``.

    Up to BROADCAST terms, each task looks for them in its texts; beyond, distinct terms of each text
    are joined with them.
    """
    terms = frozenset(r["term"] for r in wanted.collect()) if n_wanted <= BROADCAST else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                own = {m.lower() for m in _TERM.findall(text)} if text else set()
                for t in own & terms if terms is not None else own:
                    total[t] = total.get(t, 0) + 1
            if len(total) > BROADCAST:
                yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["term", "n"])
                total = {}
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["term", "n"])

    counted = rows.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_term"))
    return counted.join(wanted, "term", "left_semi")


def private_spans(docs: DataFrame, disclosed: float = DISCLOSED, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, n_secret, n_term, base_sha256, spans) and the columns ``keep`` of each row.

    A protected entity is the value of a match of the base kinds, or of a secret: what stands behind a name
    like token or password and a colon or equals sign. Over all documents, the pointwise mutual information
    of a term and an entity, log2(n(term, entity) * N / (n(term) * n(entity))), is how much the term tells of
    the entity; a term that tells more than ``disclosed`` of the entity's own information, log2(N / n(entity)),
    is a span too, wherever it stands outside the matches, in any document. Documents count whole, whatever
    the distance of term and match. Copies of one passage are one piece of evidence: a pair needs CONTEXTS
    different contexts, of a match for terms within REACH terms of it, else of the term. Null texts count as
    empty; ids, null ones too, are returned as they are; rows of one id are judged each for itself. Texts of
    any length are searched whole. Columns of ``keep`` must not have a name of the operator's own; a clash is
    an error. An empty table gives no rows.
    """
    free_names(keep, "doc_id", "text", "more", "row", "base_sha256", "spans", *(f"n_{k}" for k in (*KINDS, SECRET, TERM)))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), *[docs[c] for c in keep])
    total = max(1, rows.count())
    entities = table(entities_of(rows), "entities")
    # An entity of fewer matches has no pair with enough contexts.
    often = entities.where(F.col("n_matches") >= CONTEXTS)
    n_often = often.count()
    none = rows.withColumn("more", F.lit(None).cast("array<struct<s: int, e: int>>"))
    if not n_often:
        discard(entities)
        return spans_of(none, frozenset(), keep)
    names = frozenset(r["entity"] for r in often.select("entity").collect()) if n_often <= BROADCAST else None
    pairs = table(pairs_of(rows, names).where(F.col("n_marks") >= CONTEXTS).drop("n_marks"), "pairs")
    wanted = pairs.select("term").distinct()
    n_wanted = wanted.count()
    if not n_wanted:
        discard(entities, pairs)
        return spans_of(none, frozenset(), keep)
    known = pairs.join(often, "entity").join(term_counts(rows, wanted, n_wanted), "term")
    pmi = F.log2(F.col("n_both") * F.lit(float(total)) / (F.col("n_term") * F.col("n_entity")))
    own = F.log2(F.lit(float(total)) / F.col("n_entity"))
    telling = table(known.where((own > 0) & (pmi >= disclosed * own)).select("term").distinct(), "telling")
    discard(entities, pairs)
    if telling.count() <= BROADCAST:
        terms = frozenset(r["term"] for r in telling.collect())
        discard(telling)
        return spans_of(none, terms, keep)
    marked = table(rows.withColumn("row", F.monotonically_increasing_id()), "private-rows")
    return spans_of(marked.join(occurrences(marked, telling), "row", "left"), frozenset(), keep)


def redact(text: str, spans: str) -> str:
    """The text with each span generalised to the name of its kind; overlapping spans become one."""
    out, at = [], 0
    for s, e, kind in sorted((int(x.split(":")[1]), int(x.split(":")[2]), x.split(":")[0]) for x in spans.split(",") if x):
        if s >= at:
            out += [text[at:s], f"[{kind}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of each row with all spans generalised. Null texts stay null; ids may be null or repeat."""
    rows = numbered(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")))
    spans = private_spans(rows, keep=("__row",)).select("__row", "spans").where("spans <> ''")

    @F.pandas_udf("string")
    def clean(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or s is None else redact(t, s) for t, s in zip(text, spans)], dtype=object)

    return rows.join(spans, "__row", "left").select("doc_id", clean("text", "spans").alias("text"))
