"""Secret scans: fixed patterns, and dictionary-primed zstandard novelty for other strings in a sensitive context.

Patterns (kinds assign, access, hex) are matched leftmost and without overlap for each kind; a match that fails its
length is dropped, yet what it covers isn't searched again. A span is the whole match in code points, end exclusive; for
an assignment, `value` says where its value (group 2) begins.

Novelty (kind novel): of each run of 16 or more characters of keys, what follows the sensitive words at its start is a
candidate if such a word ends at most REACH characters before it; else what follows the first sensitive word within it.
So candidates don't overlap, and a text's time grows with its length. A candidate's marginal size is what it adds to the
compressed text around it, with a compressor primed with two dictionaries: a fixed list of identifiers, and those that
stand near sensitive words in most documents (counted over all documents, the DICTIONARY first of LEAST_DOCS or more). A
name or phrase that the surroundings or the dictionaries hold costs little; a random string costs nearly its length. It
is reported if its marginal bytes are at least `novelty` times its length (LETTERS more for one without digits) and it
overlaps no pattern's span.

Defined results: a null or empty text has no spans. Rows are independent but for the dictionary: null ids and other
columns don't matter, and repeated rows give equal results. Every text is scanned whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The patterns, fixed values: kind, pattern, group whose length counts, its least length.
KINDS = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]{24,}"), 0, 24),  # a run of [0-9a-f] is one match, so its length can be asked for at once
)
NOVEL = "novel"
SENSITIVE = r"pass(word|wd|phrase|code)|pwd|secret|token|api[_-]?key|credential|bearer|authorization|(private|access|signing)[_-]?key|client[_-]?id"
#: What any text with a span has.
MAY = f"(?i:{SENSITIVE})|AKIA[A-Z0-9]{{16}}|[0-9a-f]{{24}}"
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
REACH, AROUND = 80, 512
#: Identifiers that are no secrets, a fixed list.
IDENTIFIERS = (
    "password passwd secret token api_key apikey access_key secret_key private_key client_id client_secret authorization bearer basic "
    "credential credentials username user_name user_id session_id session_token refresh_token id_token csrf_token environment getenv "
    "os.environ process.env config settings default required optional example placeholder changeme your_token_here your_api_key_here "
    "null none true false undefined string bytes length value key header headers request response content type application json "
    "https http localhost database connection_string host port encode decode base64 sha256 md5 hexdigest signature public certificate "
    "import from return function class const let var static final private public protected self this new def async await"
)
DICTIONARY, LEAST_DOCS, LETTERS = 2000, 5, 0.15
SCHEMA = "doc_id long, spans array<struct<kind:string,start:int,end:int,bytes:int,value:int>>"
_sensitive = re.compile(SENSITIVE, re.IGNORECASE | re.ASCII)
_identifier = re.compile("[A-Za-z_]{4,32}")
_compressors: dict[str, zstandard.ZstdCompressor] = {}


def compressed(data: bytes, known: str) -> int:
    """Compressed size with the dictionaries; known: the one that was counted."""
    if known not in _compressors:
        _compressors.clear()
        words = zstandard.ZstdCompressionDict(f"{known} {IDENTIFIERS}".encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        _compressors[known] = zstandard.ZstdCompressor(level=6, dict_data=words, write_content_size=False, write_dict_id=False)
    return len(_compressors[known].compress(data))


def marginal_bytes(text: str, start: int, end: int, known: str = "") -> int:
    """Compressed bytes that text[start:end] adds to what stands around it."""
    before, after = text[max(0, start - AROUND) : start].encode(), text[end : end + AROUND].encode()
    return compressed(before + after + text[start:end].encode(), known) - compressed(before + after, known)


def base_spans(text: str) -> list[tuple[int, int, int, int | None]]:
    """(start, order of the kind, end, where an assignment's value begins) of the patterns' matches, sorted."""
    out = []
    for k, (_, pattern, group, least) in enumerate(KINDS):
        out += [(m.start(), k, m.end(), m.start(group) if group else None) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(out)


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the strings in a sensitive context, in order; they don't overlap."""
    words = [m.span() for m in _sensitive.finditer(text)]
    nxt, last = 0, -REACH - 1  # the first word that doesn't end before the run, and the end of the word before that
    for m in CANDIDATE.finditer(text):
        s, e = m.span()
        while nxt < len(words) and words[nxt][1] <= s:
            last, nxt = words[nxt][1], nxt + 1
        k = nxt
        if s - last > REACH:
            if k == len(words) or words[k][0] >= e:
                continue
            s, k = words[k][1], k + 1
        while k < len(words) and words[k][0] <= s + 1 and words[k][1] < e:  # words joined by one separator at most
            s, k = words[k][1], k + 1
        if e - s >= 16:
            yield s, e


def novel_spans(text: str, taken: list[tuple[int, int, int, int | None]], novelty: float, known: str = "") -> list[tuple[int, int, int, int]]:
    """(start, order, end, marginal bytes) of novel candidates that overlap no span of `taken`, which is sorted."""
    out, at, reached = [], 0, 0
    for s, e in candidates(text):
        while at < len(taken) and taken[at][0] < e:
            reached, at = max(reached, taken[at][2]), at + 1
        own = text[s:e]
        digits, upper, lower = (re.search(c, own) is not None for c in ("[0-9]", "[A-Z]", "[a-z]"))
        if reached > s or not (digits and (upper or lower) or upper and lower):
            continue
        n = marginal_bytes(text, s, e, known)
        if n >= (novelty if digits else novelty + LETTERS) * (e - s):
            out.append((s, len(KINDS), e, n))
    return out


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, docs): identifiers around sensitive words, with their documents in the batch."""
    for batch in batches:
        texts, counts = batch.column("text").fill_null(""), Counter()
        for i in np.flatnonzero(pc.match_substring_regex(texts, f"(?i:{SENSITIVE})").to_numpy(zero_copy_only=False)):
            text, own, done = texts[int(i)].as_py(), set(), 0
            for m in _sensitive.finditer(text):
                begin = max(done, m.start() - AROUND)
                done = max(done, min(len(text), m.end() + AROUND))
                own.update(_identifier.findall(text, begin, done))
            counts.update(own)
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "docs"])


def dictionary(docs: DataFrame) -> str:
    """The DICTIONARY identifiers that stand near sensitive words in most documents, the most frequent last, where zstandard finds them cheapest."""
    counted = docs.select("text").mapInArrow(_near, "word string, docs long").groupBy("word").agg(F.sum("docs").alias("docs"))
    found = counted.where(F.col("docs") >= LEAST_DOCS).orderBy(F.desc("docs"), "word").limit(DICTIONARY).collect()
    return " ".join(r.word for r in reversed(found))


def _scan(batches: Iterator[pa.RecordBatch], novelty: float, known: str) -> Iterator[pa.RecordBatch]:
    names = [k for k, *_ in KINDS] + [NOVEL]
    for batch in batches:
        texts = batch.column("text").fill_null("")
        some = pc.match_substring_regex(texts, MAY).to_pylist()
        out = []
        for i, hit in enumerate(some):
            spans = []
            if hit:
                text = texts[i].as_py()
                base = base_spans(text)
                every = [(s, k, e, None, v) for s, k, e, v in base] + [(*x, None) for x in novel_spans(text, base, novelty, known)]
                spans = [{"kind": names[k], "start": s, "end": e, "bytes": n, "value": v} for s, k, e, n, v in sorted(every, key=lambda x: x[:2])]
            out.append(spans)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("bytes", pa.int32()), ("value", pa.int32())]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, kind)], ["doc_id", "spans"])


def find_secrets(docs: DataFrame, novelty: float = 0.75, known: str | None = None) -> DataFrame:
    """(doc_id, spans) of each row: spans by start, then kind; bytes is the marginal size of a novel one, value where an assignment's value begins.

    known: the counted dictionary; by default that of `docs`.
    """
    known = dictionary(docs) if known is None else known
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return rows.mapInArrow(lambda it: _scan(it, novelty, known), SCHEMA)


def digests(found: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, value_starts) of what find_secrets() returns; value_starts: where the values of the assignments begin."""
    said = "concat_ws(':', x.kind, x.start, x.end)"
    return found.select(
        "doc_id",
        *[F.expr(f"cast(size(filter(spans, x -> x.kind = '{k}')) as long)").alias(f"n_{k}") for k, *_ in KINDS],
        F.expr(f"sha2(array_join(transform(filter(spans, x -> x.kind <> '{NOVEL}'), x -> {said}), ','), 256)").alias("base_sha256"),
        F.expr(f"array_join(transform(spans, x -> {said}), ',')").alias("spans"),
        F.expr("array_join(transform(filter(spans, x -> x.value is not null), x -> cast(x.value as string)), ',')").alias("value_starts"),
    )
