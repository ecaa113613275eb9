"""Secret scans: fixed patterns, and strings that dictionary-primed compression cannot shorten.

Every text is searched for three patterns. Beyond them, each long string that
stands shortly after a sensitive word is a candidate, and so is the value of each
NAME=value with a sensitive word in its name, each long string of a private key
block, and each that follows another one of these, or the value of a fixed pattern,
after white space only (lines of one key). Its novelty is what it adds,
in bytes, to the zstandard form of the text around it, with a dictionary of
identifiers primed beforehand: names and words that code or the corpus use cost
little, random keys cost nearly all of their bytes. Candidates of any length are
measured in pieces, and reported whole as `novel` spans if a piece is incompressible. The dictionary joins fixed code words with the most
frequent identifiers of all documents.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_rows, bounded_arrow, columns_of, unused_name

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Of the maximal runs [0-9a-f]+, only those of 16 or more are kept; the pattern finds just these.
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.~-]{16,}", re.A)
SENSITIVE = re.compile(r"passw|pwd|secret|token|api[_ -]?key|auth|bearer|credential|private[_ -]?key|access[_ -]?key|signature|\bkey\b", re.I | re.A)
#: What parts a name from its value within a run; signs at the end of a run belong to it.
SIGN = re.compile(r"=+(?=[^=])")
#: Beginnings and ends of private key blocks; what may stand between lines of a block; its last line, where too short for a candidate.
BLOCK = re.compile(r"PRIVATE KEY(?: BLOCK)?-----|(-----END)")
BETWEEN = " \t\r\n\v\f\\"
LAST = re.compile(r"(?:[\s\\]|(?<=\\)[nr])([A-Za-z0-9+/=]{1,15})(?:\s|\\[nr])*\Z", re.A)
#: Characters before a candidate in which a sensitive word counts, and the text around it that it is measured against.
NEAR, AROUND = 48, 256
#: A candidate is novel if it, or one of its even pieces of at most so many characters, adds at least this share of its bytes.
NOVELTY, PIECE = 0.7, 512
#: Identifiers taken from the corpus: at most so many, each in at least so many documents.
IDENTIFIERS, LEAST_DOCUMENTS = 2000, 5
#: Words that code is made of.
CODE_WORDS = """
abstract access account address admin algorithm allow amazonaws apache api application argument array async
attribute authorization await base64 bearer begin binary boolean bucket buffer build bytes cache callback
certificate channel class client cloud cluster code column command comment commit common compile component
config connection const constructor container content context continue controller cookie count create
credentials current data database date debug decode default define delete deploy description digest directory
docker document domain double download driver else email encode encrypt endpoint engine enum environment error
event example exception execute export extends false field file filter final float format function generate
getenv github global group handler hash header hidden host html http https identifier image implements import
include index info input insert install instance integer interface internal items iterator javascript json key
kubernetes label lambda language length library license limit list load local localhost location login manager
mapping master message method model module name namespace network node null number object openssl operator
option order output package parameter parent parse password path pattern permission pipeline platform plugin
policy port prefix print private process production profile project property protected protocol provider public
python query queue random readme record redirect reference region release remote render replace repository
request require reset resource response result return role root router runtime schema script secret section
select self server service session settings shared signature source staging static status storage stream string
struct style submit super switch system table target template test text thread throw timeout timestamp title
token transaction true type undefined update upload user username utils value variable vector version view
virtual void volume warning webhook window worker write yaml your_api_key_here changeme placeholder xxxxxxxx
"""


def identifiers(docs: DataFrame, most: int = IDENTIFIERS, least: int = LEAST_DOCUMENTS) -> list[str]:
    """The most frequent compound identifiers (letters joined by _ or by inner capitals) of all documents, in document counts."""
    found = F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(r"\b(?:[A-Za-z]{2,15}(?:_[A-Za-z]{2,15}){1,3}|[a-z]{2,15}(?:[A-Z][a-z]{2,15}){1,3})\b"), F.lit(0))
    words = docs.select(F.explode(F.array_distinct(found)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return [r[0] for r in words.filter(F.col("n") >= least).orderBy(F.col("n").desc(), "word").limit(most).collect()]


@lru_cache(maxsize=4)
def _compressor(words: tuple[str, ...]) -> zstandard.ZstdCompressor:
    primed = zstandard.ZstdCompressionDict(" ".join([*reversed(words), *CODE_WORDS.split()]).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=9, dict_data=primed, write_content_size=False, write_dict_id=False)


def novelty(candidate: str, around: str, words: tuple[str, ...] = ()) -> float:
    """Bytes that the candidate adds to the compressed text around it, as a share of its own."""
    press = _compressor(words).compress
    plain = around.encode()
    own = candidate.encode()
    return (len(press(plain + own)) - len(press(plain))) / max(1, len(own))


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the secret itself) of the fixed patterns, by start and kind."""
    found = [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(found)


def _novel(text: str, start: int, end: int, words: tuple[str, ...]) -> bool:
    around = text[max(0, start - AROUND) : start] + text[end : end + AROUND]
    n = -(-(end - start) // PIECE)
    at = [start + (end - start) * i // n for i in range(n + 1)]
    return any(novelty(text[a:b], around, words) >= NOVELTY for a, b in zip(at, at[1:]))


def key_blocks(text: str) -> list[tuple[int, int]]:
    """(start, end) of what stands in private key blocks, a block without an end left out."""
    blocks, start = [], None
    for m in BLOCK.finditer(text):
        if not m[1]:
            start = m.end()
        elif start is not None:
            blocks.append((start, m.start()))
            start = None
    return blocks


def _secret(text: str, start: int, end: int, near: bool, words: tuple[str, ...]) -> int | None:
    """Where the secret of a run begins, which goes on to its end; near tells of a sensitive word before the run."""
    values, named, at = [], [], start
    for m in SIGN.finditer(text, start, end):
        values.append(m.end())
        if SENSITIVE.search(text, at, m.start()):
            named.append(m.end())
        at = m.end()
    for a, b in zip(named, [*named[1:], end]):
        if b - a >= LEAST_ASSIGN and _novel(text, a, b, words):
            return start if near and _novel(text, start, a, words) else a
    if near and _novel(text, start, end, words):
        return start
    if near and values and end - values[0] >= LEAST_ASSIGN and _novel(text, values[0], end, words):
        return values[0]
    return None


def _end_before(text: str, at: int) -> int:
    """End of what stands before at and the white space there, line ends written as \\r or \\n included."""
    while at and (text[at - 1] in BETWEEN or text[max(0, at - 2) : at] in ("\\r", "\\n")):
        at -= 1
    return at


def _last_lines(text: str, blocks: list[tuple[int, int]], ends: set[int]) -> list[tuple[int, int, int, int]]:
    """Spans of the short last lines of blocks whose line before ends at one of ends."""
    found = []
    for start, end in blocks:
        low = max(start, end - AROUND)
        if (m := LAST.search(text, low, end)) and _end_before(text, m.start(1)) in ends:
            found.append((m.start(1), 3, m.end(1), m.start(1)))
    return found


def scan(text: str, words: tuple[str, ...] = ()) -> list[tuple[int, int, int, int]]:
    """All spans of a text; novel ones lie outside the others."""
    found = base_spans(text)
    taken = [(s[0], s[2]) for s in found]
    blocks = key_blocks(text) if "PRIVATE KEY" in text else []
    block = 0
    carried = {s[2] for s in found if s[1] < 2}
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        while block < len(blocks) and blocks[block][1] <= start:
            block += 1
        if block < len(blocks) and blocks[block][0] < end:  # dashes of the block's ends may join its lines
            start, end = max(start, blocks[block][0]), min(end, blocks[block][1])
            near = True
        else:
            before = _end_before(text, start)
            near = before < start and before in carried or SENSITIVE.search(text, max(0, start - NEAR), start) is not None
        if not near and "=" not in m.group():
            continue
        begin = _secret(text, start, end, near, words)
        if near or begin is not None:
            carried.add(end)
        if begin is not None and not any(a < end and begin < b for a, b in taken):
            found.append((begin, 3, end, begin))
    return sorted(found + _last_lines(text, blocks, {s[2] for s in found}))


def joined(spans: list[tuple[int, int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in spans)


def redact(text: str, spans: list[tuple[int, int, int, int]], mark: str = "[SECRET]") -> str:
    """text with every secret replaced by mark; overlapping spans become one."""
    out, at = [], 0
    for start, end in sorted((s[3], s[2]) for s in spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def secret_table(docs: DataFrame, words: list[str] | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_novel of every row.

    Null and empty texts have no spans. Positions count code points of the whole
    text. Repeated rows give repeated rows; other columns are ignored.
    """
    bounded_arrow(docs.sparkSession)
    known = tuple(identifiers(docs) if words is None else words)

    def run(batches):
        for ids, texts in as_rows(batches, "doc_id", "text"):
            rows = []
            for i, t in zip(ids, texts):
                spans = scan(t or "", known)
                base = [s for s in spans if s[1] < 3]
                counts = [sum(s[1] == k for s in spans) for k in range(4)]
                rows.append((i, *counts[:3], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), counts[3]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            columns = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 7, kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel"])

    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return thin.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long")


def redacted(docs: DataFrame, words: list[str] | None = None) -> DataFrame:
    """docs with every secret in `text` replaced by [SECRET], and `n_chars`, where there is one, counted anew for changed texts."""
    bounded_arrow(docs.sparkSession)
    known = tuple(identifiers(docs) if words is None else words)
    before = unused_name(docs, "_before")
    names, place = [*docs.columns, before], docs.columns.index("text")

    def run(batches):
        for b in batches:
            texts = [t and redact(t, scan(t, known)) for t in b.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:place], pa.array(texts, pa.string()), *b.columns[place + 1 :], b.column(place)], names=names)

    schema = T.StructType([*[T.StructField("text", T.StringType()) if f.name == "text" else f for f in docs.schema.fields], T.StructField(before, T.StringType())])
    plain = docs.withColumn("text", F.col("text").cast("string")).toDF(*[f"c{i}" for i in range(len(docs.columns))])  # names with dots can't be passed on
    out = plain.mapInArrow(run, schema)
    if "n_chars" in docs.columns:
        changed = ~F.col("text").eqNullSafe(F.col(before))
        out = out.withColumn("n_chars", F.when(changed, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*columns_of(docs))
