"""Secret scan: fixed patterns, and a linear-chain CRF that adds spans.

Tokens are runs of ``[A-Za-z0-9+/_=-]``; the chain of a text is all its tokens.
Viterbi runs over whole texts, many at once.  Features: shape, length, character
set, neighbouring words and what stands between them, and whether the text names
a secret at all.

The CRF is fitted on windows of a bounded sample of texts (``SAMPLE_DOCS``,
``SAMPLE_CHAINS``) whose base matches serve as tags.  As it is to find what the
patterns miss, each sampled text with a match is also taken in disguise: names
without their separator or gone, key prefixes replaced, hexadecimal digits in
upper case, tags kept.  Starting a span costs ``MARGIN`` more than fitted, as the
windows hold more secrets than texts do.

Base spans are whole matches of the three patterns.  Of a CRF span that reaches
over a base span the parts outside are listed.  Offsets are code points, the end
exclusive.

Defined cases: a null or empty text has no spans; repeated rows are scanned
each for itself; without any base match in the sample the CRF adds nothing; an
empty table gives an empty result; extra columns stay.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortkit.llm.crf import B, ChainCRF, I, O

# Patterns and least lengths: fixed values.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # runs are whole, so a run of 32 or more is a match that passes
_HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "crf")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

SLOTS = 1 << 14
SAMPLE_DOCS = 20_000     # texts, chosen by a hash of id and text, that the CRF is fitted on, about
SAMPLE_CHAINS = 6_000    # windows among them, at most
SAMPLE_LENGTH = 16       # tokens of a window
SAMPLE_PLAIN = 3_000     # windows without a secret among them, about
MARGIN = 2.0
MASK = "[SECRET]"
_SPACE = " \t\n\r\"'"
_EDGE = re.compile(f"[{_SPACE}]*")
_WORD = re.compile(r"[A-Za-z0-9]")

_VALUE = np.zeros(256, bool)
_VALUE[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]] = True


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _slot(feature: str) -> int:
    return zlib.crc32(feature.encode()) % SLOTS


_few = lru_cache(1 << 12)(_slot)  # features of few values


def _shape(token: str) -> str:
    if token.isalpha() and (token.islower() or token.istitle()):  # most words
        return "x" if token.islower() else "Xx" if len(token) > 1 else "X"
    out = re.sub(r"[A-Z]+", "X", re.sub(r"[a-z]+", "x", token))
    out = re.sub(r"[0-9]+", "9", out)
    return out if len(out) <= 6 else "mixed" + str(min(8, len(out).bit_length()))


def _charset(token: str) -> str:
    if token.isalpha():
        return ("lower" if token.strip("abcdef") else "hex") if token.islower() else "upper" if token.isupper() else "any"
    if re.fullmatch(r"[0-9]+", token):
        return "digits"
    kind = ("hex" if re.fullmatch(r"[0-9a-f]+", token) else "upper" if re.fullmatch(r"[A-Z0-9]+", token)
            else "lower" if re.fullmatch(r"[a-z0-9]+", token) else "any" if re.fullmatch(r"[A-Za-z0-9]+", token) else "symbols")
    return kind + ("9" if re.search(r"[0-9]", token) else "")


def _between(gap: str) -> str:
    gap = gap.strip(" ")
    return gap if len(gap) <= 2 else "far"


def _own(token: str) -> list[int]:
    return _own_kept(token) if len(token) <= 64 else _own_kept.__wrapped__(token)


@lru_cache(1 << 16)
def _own_kept(token: str) -> list[int]:
    size = min(len(token).bit_length(), 9)
    spread = len(set(token)) * 4 // min(len(token), 64)
    kind = _charset(token)
    return [_few("bias"), _few(f"shape={_shape(token)}"), _few(f"size={size}"), _few(f"set={kind}"), _few(f"set,size={kind},{size}"),
            _few(f"spread={spread}"), _slot(f"head={token[:4]}")]


def _left(token: str) -> str:
    return token.lower()[-16:]


FEATURES = 13
_NAMED = (_slot("named=False"), _slot("named=True"))


def _distinct(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """Codes and distinct values of the strings that end at ``ends`` in ``data``."""
    offsets = np.concatenate(([0], ends))
    values = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [
        None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    return values.indices.to_numpy().astype(np.int64), [v.decode(errors="replace") for v in values.dictionary.to_pylist()]


class Chains:
    """Tokens of many texts: their text, code-point span, feature slots, and whether they start a text."""

    def __init__(self, texts: list[str]):
        parts = [t.encode() for t in texts]
        raw = np.frombuffer(b"\n".join([b"", *parts, b""]), np.uint8)  # no token reaches over a line's end
        begins = 1 + np.concatenate(([0], np.cumsum([len(p) + 1 for p in parts], dtype=np.int64)))
        value = _VALUE[raw]
        step = np.diff(value.astype(np.int8))
        start, end = np.flatnonzero(step == 1) + 1, np.flatnonzero(step == -1) + 1
        self.text = np.searchsorted(begins, start, "right") - 1
        place = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
        self.start, self.end = (place[x] - place[begins[self.text]] for x in (start, end))
        n = len(start)
        self.first = np.concatenate(([True], np.diff(self.text) != 0))[:n]
        self.slots = np.zeros((n, FEATURES), np.int32)
        if not n:
            return
        last = np.concatenate((self.first[1:], [True]))
        code, words = _distinct(raw[value], np.cumsum(end - start))
        gap_ends = np.concatenate((np.cumsum(start - np.concatenate(([0], end[:-1]))), [(~value).sum()]))
        gap, gaps = _distinct(raw[~value], gap_ends)
        before, after = np.where(self.first, len(gaps), gap[:-1]), np.where(last, len(gaps), gap[1:])
        previous = np.where(self.first, len(words), np.concatenate(([0], code[:-1])))
        following = np.where(last, len(words), np.concatenate((code[1:], [0])))
        own = np.array([_own(w) for w in words], np.int32)
        left = [_left(w) for w in words] + [""]
        between = [_between(g) for g in gaps] + ["edge"]
        self.slots[:, :7] = own[code]
        self.slots[:, 7] = np.array([_slot(f"left={w}") for w in left])[previous]
        self.slots[:, 8] = np.array([_slot(f"gap={g}") for g in between])[before]
        pair, which = np.unique(previous * len(between) + before, return_inverse=True)
        self.slots[:, 9] = np.array([_slot(f"left,gap={left[p // len(between)]},{between[p % len(between)]}")
                                     for p in pair.tolist()])[which]
        self.slots[:, 10] = np.array([_few(f"right={_shape(w[:12])}") for w in [*words, ""]])[following]
        self.slots[:, 11] = np.array([_slot(f"gapright={g}") for g in between])[after]
        named = np.array([any(k in t for k in KEYWORDS) for t in (t.lower() for t in texts)])
        self.slots[:, 12] = np.where(named[self.text], _NAMED[1], _NAMED[0])


def weak_tags(spans: list[tuple[int, int]], base: list[tuple[int, int]]) -> list[int]:
    """B for a text's first token in a secret, I for the next ones in it; both in their order."""
    tags, now, i = [], None, 0
    for a, b in spans:
        while i < len(base) and base[i][1] <= a:
            i += 1
        hit = i if i < len(base) and base[i][0] < b else None
        tags.append(O if hit is None else I if hit == now else B)
        now = hit
    return tags


def values(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the secrets themselves, an assignment without its name; those inside an earlier one left out."""
    out, reach = [], 0
    for a, k, b in base_spans(text):
        if k == 0:
            a = ASSIGN.match(text, a).start(2)
        if a >= reach:
            out.append((a, k, b))
            reach = b
    return out


def disguised(text: str, seed: int) -> tuple[str, list[tuple[int, int]]]:
    """The text with its secrets in forms that the patterns miss, and where they are."""
    out, spans, at, size = [], [], 0, 0
    matches = {m.start(2): m for m in ASSIGN.finditer(text)}
    for j, (a, k, b) in enumerate(values(text)):
        form = zlib.crc32(f"{seed}:{j}".encode()) % 4
        secret, head = text[a:b], text[at:a]
        if k == 0 and matches[a].start() >= at:
            name = "" if form == 0 else matches[a][1] + (" is " if form % 2 else " ")
            head = text[at:matches[a].start()] + name
        if k == 1:
            secret = secret[-4:] + secret[4:]
        elif k == 2 or _HEX.fullmatch(secret):
            secret = secret.upper() if form < 3 else secret
        out += [head, secret]
        size += len(head)
        spans.append((size, size + len(secret)))
        size += len(secret)
        at = b
    return "".join([*out, text[at:]]), spans


def _training(batches: Iterator[pa.RecordBatch], every: int) -> Iterator[pa.RecordBatch]:
    """Windows with a secret, of texts as they are and in disguise, and one in ``every`` of the others."""
    for batch in batches:
        rows = []
        for key, t in zip(batch.column("key").to_pylist(), batch.column("__text")):
            text = t.as_py()
            if not text:
                continue
            found = [(a, b) for a, _, b in values(text)]
            for j, (form, secrets) in enumerate([(text, found), disguised(text, key)] if found else [(text, found)]):
                chains = Chains([form])
                tags = np.array(weak_tags(list(zip(chains.start.tolist(), chains.end.tolist())), secrets), np.int32)
                for at in range(0, len(tags), SAMPLE_LENGTH):
                    part = tags[at:at + SAMPLE_LENGTH].copy()
                    if not part.any() and (j or zlib.crc32(f"{key}:{at}".encode()) % every):
                        continue
                    part[0] = part[0] and B
                    rows.append((key, j, at, chains.slots[at:at + SAMPLE_LENGTH].ravel(), part))
        cols = list(zip(*rows)) if rows else [[]] * 5
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                         names=["key", "form", "at", "features", "tags"])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS,
        sample_chains: int = SAMPLE_CHAINS) -> ChainCRF:
    """CRF fitted on windows of the texts of ``docs`` with the lowest hashes."""
    text = F.col(text_col).cast("string")
    total, chars = docs.agg(F.count(F.lit(1)), F.sum(F.length(text).cast("double"))).first()
    space = 1 << 30
    share = min(1.0, sample_docs / max(1, total))
    windows = share * (chars or 0) / (6 * SAMPLE_LENGTH)  # a word has about six characters
    every = max(1, int(windows / SAMPLE_PLAIN))
    rows = (docs.select(F.xxhash64(F.col(id_col), text).alias("key"), text.alias("__text"))
            .filter(F.pmod("key", F.lit(space)) < int(space * share))
            .mapInArrow(lambda it: _training(it, every), "key long, form int, at long, features array<int>, tags array<int>")
            .orderBy("key", "form", "at", "features").limit(sample_chains).collect())
    model = ChainCRF(SLOTS)
    by: dict[int, tuple[list, list]] = {}
    for r in rows:
        f, t = by.setdefault(len(r.tags), ([], []))
        f.append(np.array(r.features, np.int32).reshape(-1, FEATURES))
        t.append(r.tags)
    groups = [(np.stack(f), np.array(t)) for _, (f, t) in sorted(by.items())]
    if any((t != O).any() for _, t in groups):
        model.fit(groups)
        model.start[B] -= MARGIN
        model.moves[:, B] -= MARGIN
    else:
        model.start[B] = model.moves[O, B] = -1.0  # nothing to learn from: all outside
    return model


def scan_text(text: str | None, model: ChainCRF) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every span of a text."""
    return scan_texts([text], model)[0]


def scan_texts(texts: list[str | None], model: ChainCRF) -> list[list[tuple[int, int, int]]]:
    found = [base_spans(t) if t else [] for t in texts]
    chains = Chains([t or "" for t in texts])
    tags = model.best(chains.slots, chains.first)
    hit = np.flatnonzero(tags)
    for k, a, b, tag in zip(*(x[hit].tolist() for x in (chains.text, chains.start, chains.end, tags))):
        if tag == B:
            found[k].append((a, 3, b))
        else:  # the span before it in the same text goes on
            found[k][-1] = (found[k][-1][0], 3, b)
    return [sorted(_outside(f, t)) if f else f for f, t in zip(found, texts)]


def _outside(spans: list[tuple[int, int, int]], text: str) -> list[tuple[int, int, int]]:
    """The base spans, and the parts of the CRF spans outside them that hold a token."""
    base = sorted((a, b) for a, k, b in spans if k != 3)
    if len(base) == len(spans):
        return spans
    out, i, reach = [s for s in spans if s[1] != 3], 0, 0
    for start, end in sorted((a, b) for a, k, b in spans if k == 3):  # CRF spans don't overlap one another
        at = max(start, min(reach, end))
        while i < len(base) and base[i][0] < end:
            out.append((at, 3, base[i][0]))
            at = max(at, min(base[i][1], end))
            reach = max(reach, base[i][1])
            i += 1
        out.append((at, 3, end))
    trimmed = []
    for a, k, b in out:
        if k == 3:
            part = text[a:b] if a < b else ""
            if not _WORD.search(part):
                continue
            a, b = a + _EDGE.match(part).end(), a + len(part.rstrip(_SPACE))
        trimmed.append((a, k, b))
    return trimmed


def spell(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def masked(text: str, spans, mask: str = MASK) -> str:
    """The text with each run of overlapping spans replaced; an assignment keeps its name."""
    out, at = [], 0
    for a, k, b in spans:
        if k == 0:
            a = a + ASSIGN.match(text, a).start(2) - a
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mask]
        at = b
    return "".join([*out, text[at:]])


FOUND = [T.StructField("n_assign", T.LongType()), T.StructField("n_access", T.LongType()),
         T.StructField("n_hex", T.LongType()), T.StructField("base_sha256", T.StringType()),
         T.StructField("spans", T.StringType())]
CHUNK = 2 << 20  # characters of text scanned at once


def _scan(batches: Iterator[pa.RecordBatch], model: ChainCRF, keep: list[str], mask: str | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, texts, clean, held, size = [], [], [], [], 0

        def flush():
            for text, spans in zip(held, scan_texts(held, model)):
                if mask is not None:
                    clean.append(masked(text, spans, mask) if spans else None)
                    continue
                base = [s for s in spans if s[1] != 3]
                rows.append((*(sum(s[1] == k for s in base) for k in range(3)),
                             hashlib.sha256(spell(base).encode()).hexdigest(), spell(spans)))

        for t in batch.column("__text"):
            held.append(t.as_py())
            size += len(held[-1] or "")
            if size >= CHUNK:
                flush()
                held, size = [], 0
        flush()
        if mask is not None:
            extra = [pa.array(clean, pa.string())]
            names = ["__clean"]
        else:
            cols = list(zip(*rows)) if rows else [[]] * 5
            extra = [pa.array(c, pa.int64() if k < 3 else pa.string()) for k, c in enumerate(cols)]
            names = [f.name for f in FOUND]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + extra, names=[*keep, *names])


def _run(docs: DataFrame, model: ChainCRF, keep: list[str], text_col: str, mask: str | None) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS x 3 numbers
    names = [f"__{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], F.col(text_col).cast("string").alias("__text"))
    fields = FOUND if mask is None else [T.StructField("__clean", T.StringType())]
    schema = T.StructType([rows.schema[n] for n in names] + fields)
    out = rows.mapInArrow(lambda it: _scan(it, held.value, names, mask), schema)
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, names)], *[f.name for f in fields])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: ChainCRF | None = None) -> DataFrame:
    """Counts of base matches, their hash, and all spans of every row."""
    return _run(docs, model or fit(docs, id_col, text_col), [id_col], text_col, None)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars",
           mask: str = MASK, model: ChainCRF | None = None) -> DataFrame:
    """All rows of ``docs``; every span's secret is replaced by ``mask``."""
    out = _run(docs, model or fit(docs, id_col, text_col), docs.columns, text_col, mask)
    hit = F.col("__clean").isNotNull()
    return out.select(*[
        F.coalesce("__clean", F.col(c)).alias(c) if c == text_col
        else F.when(hit, F.length("__clean")).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c) if c == length_col
        else F.col(c) for c in docs.columns])
