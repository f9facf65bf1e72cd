"""Secret scans: strings that a BPE vocabulary needs too many tokens for."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siltstone.llm import kernels as K
from siltstone.llm.bpe import VOCABULARY, shared_vocabulary
from siltstone.llm.docs import texts

#: A candidate has so many characters of keys at least, and so few of them a token at most.
LEAST, RATIO = 16, 2.3
#: The same of runs of letters of one case, which may be long words of a language that the vocabulary wasn't made of.
WORD_RATIO = 1.9
#: Characters that a value needs at least if the name of a secret assigns it.
ASSIGNED = 8
#: Distinct candidates whose token counts a task remembers at once.
MEMORY = 1 << 16
SCHEMA = "doc_id bigint, start_byte bigint, end_byte bigint, n_tokens bigint, chars_per_token double, kind string"

_KEY = K._table(K._ALNUM + "+/_-", False)
_SIGN = K._table("=:", False)
_UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\Z")
_HEX = re.compile(r"([0-9a-f]+|[0-9A-F]+)\Z")
_NAME = re.compile(r"[A-Za-z]+([_/-][A-Za-z]+)*[_/-]?\d{0,4}=?\Z")
_NUMBER = re.compile(r"[\d+/=_-]+\Z")
_DIGEST_BEFORE = re.compile(r"(?i)(?:sha-?\d*|md-?5|digest|checksum|commit|etag|integrity|blake2[bs]?|crc|revision)[\"'\s:=()\[\]-]{0,6}\Z")
_NAMED = r"(?:token|secret|passw(?:or)?d|passphrase|pwd|api[_ -]?key|access[_ -]?key|private[_ -]?key|auth|bearer|credentials?)"
_SECRET_BEFORE = re.compile(rf"(?i){_NAMED}[\"'\s:=]{{0,6}}\Z")
_ASSIGNS = re.compile(rf"(?i){_NAMED}[\"'\s]{{0,2}}\Z".encode())
_VALUE = re.compile(rb"[:=\s\"'>]{1,4}([!#-&(-;?-~=]+)")
_DIGEST_LENGTHS = {32, 40, 56, 64, 96, 128}


def kind_of(text: str, before: str) -> str | None:
    """'assigned', 'bare' or 'word' (letters of one case) for a string that may be a secret; None for names, numbers, UUIDs and digests.

    Digests are hexadecimal strings of a digest's length, unless a word like
    token or password assigns them; and whatever a word like sha256 or commit
    introduces.
    """
    core = text.rstrip("=")
    if _UUID.match(core) or _NUMBER.match(text) or _DIGEST_BEFORE.search(before):
        return None
    if _SECRET_BEFORE.search(before):
        return "assigned"
    if core.isalpha() and (core.islower() or core.isupper() or core.istitle()):
        return "word"
    if _NAME.match(text) and any(c in core for c in "_/-"):
        return None
    if len(core) in _DIGEST_LENGTHS and _HEX.match(core):
        return None
    return "bare"


def assigned(buf: np.ndarray, off: np.ndarray, least: int = ASSIGNED) -> list[tuple[int, int, int]]:
    """(start, end, document) of values of any printable characters that the name of a secret and a colon or equals sign assign."""
    signs = np.flatnonzero(_SIGN[buf])
    out: list[tuple[int, int, int]] = []
    for p, d in zip(signs.tolist(), (np.searchsorted(off, signs, "right") - 1).tolist()):
        if out and p < out[-1][1] or not _ASSIGNS.search(buf[max(int(off[d]), p - 24) : p].tobytes()):
            continue
        end = min(p + 4096, int(off[d + 1]))
        while (m := _VALUE.match(tail := buf[p:end].tobytes())) and m.end() == len(tail) and end < off[d + 1]:  # a longer value
            end = min(p + 2 * (end - p), int(off[d + 1]))
        if m:
            value = m.group(1).rstrip(b".,;:)]}!?")
            if len(value) >= least:
                out.append((p + m.start(1), p + m.start(1) + len(value), d))
    return out


def candidates(buf: np.ndarray, off: np.ndarray, least: int = LEAST):
    """(starts, ends, documents) of runs of key characters long enough, with their padding; runs of letters that go on in letters outside ASCII are parts of words."""
    s, e, roff = K.runs(buf, off, _KEY)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(roff))
    on = e - s >= least
    s, e, doc = s[on], e[on], doc[on]
    if not len(s):
        return s, e, doc
    full = e.copy()
    for _ in range(2):  # padding
        full += (buf[np.minimum(full, len(buf) - 1)] == 61) & (full < off[doc + 1])
    wide = np.concatenate([buf >= 128, [False]])
    beside = wide[e] & (e < off[doc + 1]) | wide[s - 1] & (s > off[doc])
    for i in np.flatnonzero(beside).tolist():
        lo, hi = max(int(off[doc[i]]), int(s[i]) - 4), min(int(off[doc[i] + 1]), int(e[i]) + 4)
        sides = buf[lo : s[i]].tobytes().decode("utf-8", "ignore")[-1:] + buf[e[i] : hi].tobytes().decode("utf-8", "ignore")[:1]
        beside[i] = any(c.isalpha() and c > "\x7f" for c in sides) and buf[s[i] : e[i]].tobytes().isalpha()
    return s[~beside], full[~beside], doc[~beside]


def secrets(docs: DataFrame, vocabulary: str = VOCABULARY, least: int = LEAST, ratio: float = RATIO) -> DataFrame:
    """Strings that look random: (doc_id, start_byte, end_byte, n_tokens, chars_per_token, kind).

    Candidates are all runs of at least ``least`` letters, digits and ``+/_-``
    with their padding, and values of eight or more printable characters that a
    name like password or token assigns, after known digests, UUIDs, numbers
    and names are left out.  Language was what the vocabulary was made of; a
    string that it gives at most ``ratio`` characters a token isn't language
    (for letters of one case at most ``WORD_RATIO``, unless they are assigned).
    The string itself is not copied out: bytes of the UTF-8 text tell where it
    is.

    Null and empty texts have none, repeated rows are listed each, an empty
    table gives an empty result; a string that stands twice is listed twice.
    A text of any length is read whole, and so is a candidate.  Columns beside
    ``doc_id`` and ``text`` are ignored, whatever their names.  One map over
    the texts: no shuffle; a task tokenises equal candidates once.
    """
    import tiktoken

    vocab = shared_vocabulary(docs.sparkSession, vocabulary)
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def run(batches):
        encoding = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=vocab().ranks, special_tokens={})
        seen: dict[str, int] = {}

        def tokens(text: str) -> int:
            if text not in seen:
                if len(seen) >= MEMORY:
                    seen.clear()
                seen[text] = len(encoding.encode_ordinary(text))
            return seen[text]

        for batch in batches:
            ids, _ = K.ids_of(batch.column(0))
            out = []
            for lo, _, buf, off in K.blocks(*K.text_buffers(batch.column(1))):
                values = assigned(buf, off)
                starts, ends, docs_of = (x.tolist() for x in candidates(buf, off, least))
                taken = np.zeros(len(buf) + 1, bool)
                for s, e, _ in values:
                    taken[s:e] = True
                found = [(s, e, d, True) for s, e, d in values] + [(s, e, d, False) for s, e, d in zip(starts, ends, docs_of) if not taken[s:e].any()]
                for s, e, d, given in sorted(found):
                    text = buf[s:e].tobytes().decode("ascii")
                    kind = kind_of(text, buf[max(off[d], s - 32) : s].tobytes().decode("utf-8", "ignore"))
                    if kind:
                        kind = "assigned" if given else kind
                        n = tokens(text)
                        if e - s <= (min(ratio, WORD_RATIO) if kind == "word" else ratio) * n:
                            out.append((int(ids[lo + d]), s - int(off[d]), e - int(off[d]), n, (e - s) / n, kind))
            kinds = [pa.int64()] * 4 + [pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["doc_id", "start_byte", "end_byte", "n_tokens", "chars_per_token", "kind"])

    return texts(docs).mapInArrow(K.tidy(run), SCHEMA)
