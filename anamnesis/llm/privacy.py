"""Personal data in texts, and the words that give it away.

Emails, network addresses, card and phone numbers are found by fixed patterns in every whole text:
the protected entities. Around each of them the words nearby are counted, once for any entity, once for its kind and
once for itself; over the whole corpus all occurrences of those words are counted. A word whose occurrences stand
beside one of these far more often than chance reveals it: its disclosure is the pointwise information
log2(P(entity beside | word) / P(entity beside)). It must be significant as well: the chance of so many different texts among
its occurrences (Chernoff's bound) is weighed against the number of words and entities that could have met. Words that are both
are terms, and every occurrence in any text is found. A term that stands beside the entity in at least ``remove_share`` of
its occurrences is removed, any other is generalised to its class.

A filter of the words that can still be terms keeps the count of the corpus to them; an exact join follows. Null and empty texts have no spans. Offsets are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anamnesis.llm.bytewords import LOWER, NOT_SPACE, U, Words, text_runs
from anamnesis.llm.common import materialise, send_code

KINDS = ("email", "ip", "card", "phone")
# The patterns of the base kinds. A run of digits that fails from its first digit
# fails from every later one, so those starts are left out; the matches are the same.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9]+(?:[\x20-][0-9]+)*")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: A term is a run of what is neither white space nor one of these marks, A-Z lower-cased.
MARKS = "\"'()[]{}<>.,;:!?*_=&|#$%"
TERM = re.compile(f"[^\x20\x09-\x0D{re.escape(MARKS)}]+")
TERM_BYTES = NOT_SPACE.copy()
TERM_BYTES[[ord(c) for c in MARKS]] = False
LOWER_AZ = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}

#: Words before and after an entity that may reveal it.
NEAR_WORDS = 3
#: The least disclosure of a term in bits, and the share of its occurrences that must be beside the entity.
MIN_BITS, MIN_SHARE = 3.0, 0.2
#: Bits of significance that a term needs beyond one in all pairs of a word and an entity.
SURE_BITS = 10.0
#: Share of occurrences beside entities from which a term is removed and not generalised.
REMOVE_SHARE = 0.8
#: Bits of a filter for a term, and the least and most in all (16 MB); beyond, more words pass, and the join that follows drops them.
BITS_PER_TERM, FILTER_BITS = 32, (1 << 16, 1 << 27)
#: Different terms that a task counts before it hands them on.
TALLY_TERMS = 1_000_000


def _emails(text: str):
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def _is_address(text: str) -> bool:
    parts = [p.lstrip("0") or "0" for p in text.split(".")]
    return all(len(p) < 4 and int(p) < 256 for p in parts)


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then by start."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if "." in text:
        out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if _is_address(m[0])]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def write_spans(spans) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


#: What may hold a base kind: a digit or an at sign.
_MAY = np.zeros(256, dtype=bool)
_MAY[0x30:0x3A] = _MAY[0x40] = True


def _places(text: str, spans):
    """Words of the text as (start, end), whether each touches a span, and the first and last + 1 word that each span touches."""
    words = [(m.start(), m.end()) for m in TERM.finditer(text)]
    starts, ends = np.array([a for a, _ in words]), np.array([b for _, b in words])
    taken, touched = np.zeros(len(words), dtype=bool), []
    for _, a, b in spans:
        first, last = int(np.searchsorted(ends, a, side="right")), int(np.searchsorted(starts, b))
        taken[first:last] = True
        touched.append((first, last))
    return words, taken, touched


def _events(text: str, kind: str, a: int, b: int) -> tuple[str, str, str]:
    """What a word beside an entity stands beside: any, one of its kind, and this one."""
    own = text[a:b].translate(LOWER_AZ)
    own = "".join(c for c in own if c in "0123456789") if kind in ("card", "phone") else own
    return "", kind, f"{kind}:{own}"


def _near(text: str, spans) -> list[tuple[str, list[str]]]:
    """Terms beside the spans, each place once: (term, events); what touches a span is none."""
    if not spans:
        return []
    words, taken, touched = _places(text, spans)
    met: dict[int, set[str]] = {}
    for (kind, a, b), (first, last) in zip(spans, touched, strict=True):
        events = _events(text, kind, a, b)
        for k in [*range(max(0, first - NEAR_WORDS), first), *range(last, min(last + NEAR_WORDS, len(words)))]:
            if not taken[k] and words[k][1] - words[k][0] > 1:
                met.setdefault(k, set()).update(events)
    return [(text[words[k][0] : words[k][1]].translate(LOWER_AZ), sorted(met[k])) for k in sorted(met)]


def _with_terms(text: str, known: dict[str, bool]) -> list[tuple[str, int, int]]:
    """Base spans, then every occurrence of the ``known`` terms that touches none: to be removed, then to be generalised."""
    spans = base_spans(text)
    if not known:
        return spans
    words, taken, _ = _places(text, spans)
    more = {True: [], False: []}
    for k, (a, b) in enumerate(words):
        remove = known.get(text[a:b].translate(LOWER_AZ))
        if remove is not None and not taken[k]:
            more[remove].append(("term" if remove else "class", a, b))
    return spans + more[True] + more[False]


def find_entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(mark, near) of the rows with terms beside their base spans; mark is a hash of the text."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            near = [[] for _ in range(n)]
            texts = batch.column(1)
            for first, data, offsets in text_runs(texts):
                marks = np.append(0, np.cumsum(_MAY[data]))
                for row in (first + np.flatnonzero(np.diff(marks[offsets]))).tolist():
                    text = texts[row].as_py()
                    near[row] = _near(text, base_spans(text))
            term = pa.list_(pa.struct([("term", pa.string()), ("events", pa.list_(pa.string()))]))
            near = pa.array([[{"term": t, "events": e} for t, e in own] for own in near], term)
            held = pc.greater(pc.list_value_length(near), 0)
            yield pa.record_batch([batch.column(0), near], names=["mark", "near"]).filter(held)

    rows = docs.select(F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "mark long, near array<struct<term:string,events:array<string>>>")


def _filter_of(terms: DataFrame) -> np.ndarray:
    """Bits, a power of two of them, of which each term sets one; the driver reads a word for 64 bits at most."""
    wanted = 1 << (BITS_PER_TERM * terms.count()).bit_length()
    size = min(max(wanted, FILTER_BITS[0]), FILTER_BITS[1])

    def bits(batches):
        for batch in batches:
            for _, data, offsets in text_runs(batch.column(0)):
                hashes = Words(data, offsets, TERM_BYTES).hashes() & U(size - 1)
                yield pa.record_batch([pa.array(hashes.astype(np.int64))], names=["b"])

    bit = terms.select("term").mapInArrow(bits, "b long")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("b") % 64).cast("int"))
    table = bit.groupBy((F.col("b") / 64).cast("long").alias("w")).agg(F.bit_or(one).alias("v")).toArrow()
    out = np.zeros(size // 64, dtype=np.int64)
    out[table.column("w").to_numpy()] = table.column("v").to_numpy()
    return out.view(U)


def _passing(words: Words, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a run, and the places of those that pass the filter."""
    hashes = words.hashes()
    bit = hashes & U(64 * len(bits) - 1)
    return hashes, np.flatnonzero((bits[bit >> U(6)] >> (bit & U(63))) & U(1))


def _count_words(docs: DataFrame, text_col: str) -> int:
    """Words of all texts together."""

    def count(batches):
        total = 0
        for batch in batches:
            for _, data, offsets in text_runs(batch.column(0)):
                total += len(Words(data, offsets, TERM_BYTES))
        yield pa.record_batch([pa.array([total], pa.int64())], names=["n"])

    return docs.select(text_col).mapInArrow(count, "n long").agg(F.sum("n")).first()[0] or 0


def _count_terms(docs: DataFrame, candidates: DataFrame, text_col: str) -> DataFrame:
    """(term, n) over all texts for terms that pass the filter of ``candidates``.

    A task adds up its counts and gives each term once, or once for every ``TALLY_TERMS`` different ones.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_filter_of(candidates))

    def count(batches):
        tally: dict[bytes, int] = {}

        def rows():
            names = [name.decode("utf-8", "replace") for name in tally]
            return pa.record_batch([pa.array(names, pa.string()), pa.array(list(tally.values()), pa.int64())], names=["term", "n"])

        for batch in batches:
            for _, data, offsets in text_runs(batch.column(0)):
                words = Words(LOWER[data], offsets, TERM_BYTES)
                hashes, on = _passing(words, shared.value)
                _, lead, counts = np.unique(hashes[on], return_index=True, return_counts=True)
                for i, n in zip(on[lead].tolist(), counts.tolist(), strict=True):
                    name = words.text(i)
                    tally[name] = tally.get(name, 0) + n
                if len(tally) > TALLY_TERMS:
                    yield rows()
                    tally.clear()
        yield rows()

    return docs.select(text_col).mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _significance(docs: Column, n: Column, chance: Column) -> Column:
    """Bits of Chernoff's bound for ``docs`` of ``n`` occurrences beside an entity; it falls as ``n`` grows."""
    seen = docs / n
    other = F.when((seen < 1) & (chance < 1), (1 - seen) * F.log2((1 - seen) / (1 - chance))).otherwise(0.0)
    return F.when(seen > chance, n * (seen * F.log2(seen / chance) + other)).otherwise(0.0)


def disclosing_terms(docs: DataFrame, entities: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, near, n, share, bits, remove) of the words that reveal protected entities.

    ``entities`` is the written result of ``find_entities`` on ``docs``. Figures are those of the event (any entity, a
    kind, one entity) with the largest share.
    """
    beside = entities.select("mark", F.explode("near").alias("w"))
    beside = beside.select("mark", F.col("w.term").alias("term"), F.explode("w.events").alias("event"))
    per_doc = beside.groupBy("event", "term", "mark").agg(F.count("*").alias("near"))
    near = per_doc.groupBy("event", "term").agg(F.sum("near").alias("near"), F.count("*").alias("docs"))
    near = materialise(near, "near")
    wide = F.col("event").isin("", *KINDS)
    counted = near.groupBy("event").agg(F.sum("near").alias("places"))
    of_wide = {r["event"]: r["places"] for r in counted.where(wide).collect()}
    events = near.select("event").distinct().count()
    # One text is never significant: its bits are at most those of the number of words.
    often = near.where("docs > 1")
    single = often.where(~wide).join(counted.where(~wide), "event")
    places = F.coalesce(*[F.when(F.col("event") == e, F.lit(n)) for e, n in of_wide.items()], F.lit(0))
    candidates = often.where(wide).withColumn("places", places.cast("long")).unionByName(single)
    words = _count_words(docs, text_col)
    chance = F.least(F.lit(1.0), F.col("places") / F.lit(max(words, 1)))
    least = SURE_BITS + float(np.log2(max(words, 1)) + np.log2(max(events, 1)))
    # A word that is not significant, or says too little, with no occurrence but those beside the entity never is: the others
    # only lower both. So what is left to count grows with the terms, not with the words beside entities.
    able = (_significance(F.col("docs"), F.col("near"), chance) >= least) & (-F.log2(chance) >= MIN_BITS)
    candidates = candidates.select("term", "event", "near", "docs", "places").where(able)
    candidates = materialise(candidates, "candidates")
    counts = materialise(_count_terms(docs, candidates.select("term").distinct(), text_col), "words")
    scored = candidates.join(counts, "term")
    n = F.greatest("n", "near")
    scored = scored.withColumn("share", F.col("near") / n).withColumn("bits", F.log2(F.col("near") / n / chance))
    sure = _significance(F.col("docs"), n, chance)
    scored = scored.where((F.col("bits") >= MIN_BITS) & (F.col("share") >= MIN_SHARE) & (sure >= least))
    best = scored.groupBy("term").agg(F.max(F.struct("share", "bits", "near", "n")).alias("best")).select("term", "best.*")
    return best.select("term", "near", "n", "share", "bits", (F.col("share") >= REMOVE_SHARE).alias("remove"))


def _maybe(data: np.ndarray, offsets: np.ndarray, bits: np.ndarray) -> tuple[Words, np.ndarray]:
    """Words of a run, and the places of those that pass the filter of terms."""
    words = Words(LOWER[data], offsets, TERM_BYTES)
    return words, _passing(words, bits)[1]


class _Terms:
    """The terms of a corpus, and for every row of ``rows`` those that it holds.

    Up to ``MAX_TERMS`` are broadcast. More are joined by a number that each written row gets, in the column
    ``number``, and the terms of a row come with it in the column ``held``.
    """

    def __init__(self, docs: DataFrame, text_col: str) -> None:
        entities = materialise(find_entities(docs, text_col), "entities")
        terms = materialise(disclosing_terms(docs, entities, text_col), "terms")
        context = docs.sparkSession.sparkContext
        size = terms.count()
        self.any, self.few, self.rows = size > 0, size <= MAX_TERMS, docs
        self.known = self.bits = None
        if self.any and self.few:
            self.known = context.broadcast({r["term"]: r["remove"] for r in terms.select("term", "remove").collect()})
            self.bits = context.broadcast(_filter_of(terms))
        elif self.any:
            self.rows = self._joined(docs, terms, text_col, context.broadcast(_filter_of(terms)))

    def _joined(self, docs, terms, text_col, bits):
        number, held = "_row", "_held"
        while number in docs.columns or held in docs.columns:
            number, held = number + "_", held + "_"
        rows = materialise(docs.withColumn(number, F.monotonically_increasing_id()), "rows")

        def words_of(batches):
            for batch in batches:
                numbers = batch.column(0).to_numpy()
                for first, data, offsets in text_runs(batch.column(1)):
                    words, on = _maybe(data, offsets, bits.value)
                    pairs = sorted({(int(words.row[i]), words.text(i).decode("utf-8", "replace")) for i in on.tolist()})
                    own = pa.array(numbers[[first + row for row, _ in pairs]] if pairs else [], pa.int64())
                    yield pa.record_batch([own, pa.array([t for _, t in pairs], pa.string())], names=["row", "term"])

        found = rows.select(number, text_col).mapInArrow(words_of, "row long, term string")
        found = found.join(terms.select("term", "remove"), "term").distinct()
        found = found.groupBy("row").agg(F.collect_list(F.struct("term", "remove")).alias(held)).withColumnRenamed("row", number)
        return rows.join(found, number, "left").select(*docs.columns, held)

    def finder(self):
        """A function of a batch of ``rows`` and the place of its text: (row, text, spans) of rows that may have spans."""
        few, known, bits, any_term = self.few, self.known, self.bits, self.any

        def spans(batch, at):
            texts = batch.column(at)
            for first, data, offsets in text_runs(texts):
                marks = np.append(0, np.cumsum(_MAY[data]))
                may = np.diff(marks[offsets]) > 0
                if any_term and few:
                    words, on = _maybe(data, offsets, bits.value)
                    may[words.row[on]] = True
                elif any_term:
                    held = batch.column(batch.num_columns - 1).slice(first, len(may))
                    may |= held.is_valid().to_numpy(zero_copy_only=False)
                for row in (first + np.flatnonzero(may)).tolist():
                    text = texts[row].as_py()
                    if any_term and not few:
                        own = {h["term"]: h["remove"] for h in batch.column(batch.num_columns - 1)[row].as_py() or []}
                    else:
                        own = known.value if any_term else {}
                    yield row, text, _with_terms(text, own)

        return spans


def find_private(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, mark, spans) for every row of ``docs``: base spans, then all occurrences of terms.

    The kind of a term is ``term`` where it is to be removed, ``class`` where it is generalised.
    """
    send_code(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("key"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    terms = _Terms(rows, "text")
    find = terms.finder()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for batch in batches:
            spans = [[] for _ in range(batch.num_rows)]
            for row, _, own in find(batch, 2):
                spans[row] = [{"kind": k, "start": a, "end": b} for k, a, b in own]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(spans, kind)], names=["key", "mark", "spans"])

    key = rows.schema["key"].dataType.simpleString()
    return terms.rows.mapInArrow(run, f"key {key}, mark long, spans array<struct<kind:string,start:int,end:int>>")


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each base span as its kind in brackets, terms removed, others as their class.

    Where spans overlap, the earliest decides and the others go with it.
    """
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if b <= at:
            continue
        out.append(text[at : max(a, at)])
        if a >= at:
            out.append("" if kind == "term" else f"[{word_class(text[a:b])}]" if kind == "class" else f"[{kind}]")
        at = b
    out.append(text[at:])
    return "".join(out)


def word_class(word: str) -> str:
    return "name" if word[:1].isupper() and not word.isupper() else "code" if word.isupper() else "word"


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(write_spans(s for s in spans if s[0] in KINDS).encode()).hexdigest()


#: Rows that ``sanitise`` hands back at once.
BATCH_ROWS = 1024
#: Terms that ``sanitise`` broadcasts at most; more are joined.
MAX_TERMS = 500_000


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` with private spans of ``text_col`` removed or generalised; other columns as they are.

    ``count_col`` gets the new number of characters. The terms are learned from ``docs`` itself.
    """
    send_code(docs.sparkSession)
    at = docs.columns.index(text_col)
    count_at = docs.columns.index(count_col) if count_col else None
    terms = _Terms(docs, text_col)
    find = terms.finder()

    def run(batches):
        for whole in batches:
            for low in range(0, whole.num_rows, BATCH_ROWS):
                yield cleaned(whole.slice(low, BATCH_ROWS))

    def cleaned(batch):
        texts = batch.column(at)
        changed, new = np.zeros(batch.num_rows, dtype=bool), []
        for row, text, spans in find(batch, at):
            if spans:
                changed[row] = True
                new.append(redact(text, spans))
        columns = list(batch.columns)[: len(names)]
        if new:
            columns[at] = pc.replace_with_mask(texts, pa.array(changed), pa.array(new, texts.type))
        if count_at is not None:
            columns[count_at] = pc.utf8_length(columns[at]).cast(columns[count_at].type)
        return pa.RecordBatch.from_arrays(columns, names=names)

    names = docs.columns
    return terms.rows.mapInArrow(run, docs.schema)
