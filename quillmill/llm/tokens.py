"""Token ids of whole texts by a public tokenizer file, a white-space chunk at a time, with a bounded memo of chunks.

The tokenizers handled here drop white space and never merge across it, so a text's ids are its chunks' ids in order.
Arrow splits a step of texts; each distinct chunk of the step is looked up or encoded once, and the ids are gathered.
Texts with control characters on which Python and the tokenizer disagree are encoded whole.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quillmill.llm.common import carry, in_steps

#: What :func:`encoder` keeps in a worker, as :func:`quillmill.llm.common.tidy` names it.
CACHE = "encoders"
#: Chunks that a worker remembers in each of two generations (about 200 MB in all).
MEMO = 400_000
#: Characters that one step takes at once; a longer text is cut at white space.
STEP = 1 << 22
_ODD = re.compile("[\x1c-\x1f\x85]")
_GAP = re.compile(r"\s")
#: Chunks of ASCII and Latin letters, for which normalizing is lower-casing and one pattern splits as the tokenizer does.
_LETTERS = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
_PLAIN = re.compile(f"[!-~{_LETTERS}]{{1,63}}")
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{_LETTERS}]+|[0-9]|[^a-z{_LETTERS}0-9]+")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for 256 and up, in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(other)}


_LETTER = _byte_letters()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """``ids(text)`` as uint32, equal to ``Tokenizer.encode(text, add_special_tokens=False).ids``."""

    def __init__(self, path: str, memo: int = MEMO):
        self.limit = memo
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}

    def _piece(self, p: str) -> bytes:
        b = self.known.get(p)
        if b is None:
            text = p if p.isascii() else "".join([_LETTER[x] for x in p.encode()])
            b = self.known[p] = array("I", [t.id for t in self.model.tokenize(text)]).tobytes()
        return b

    def _learn(self, chunks: list[str]) -> None:
        if len(self.memo) > self.limit:
            self.old, self.memo = self.memo, {}
        if len(self.known) > self.limit:
            self.known.clear()
        slow, memo, old = [], self.memo, self.old
        for c in chunks:
            if c in memo:
                continue
            b = old.get(c)
            if b is not None:
                memo[c] = b
            elif _PLAIN.fullmatch(c) and "<|" not in c:
                memo[c] = b"".join([self._piece(p) for p in _PIECES.findall(c.lower())])
            else:
                slow.append(c)
        if slow:
            for c, e in zip(slow, self.whole.encode_batch_fast(slow, add_special_tokens=False), strict=True):
                memo[c] = array("I", e.ids).tobytes()

    def _found(self, chunks: list[str]) -> list[bytes]:
        memo = self.memo
        try:
            return [memo[c] for c in chunks]
        except KeyError:
            self._learn(chunks)
            return [self.memo[c] for c in chunks]

    def _step(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each text's first and the end), for texts without odd characters."""
        split = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
        coded = split.flatten().dictionary_encode()
        real = pc.not_equal(coded.dictionary, "").to_numpy(zero_copy_only=False)
        found = self._found(coded.dictionary.filter(pa.array(real)).to_pylist())
        size = np.zeros(len(real), np.int64)
        size[real] = np.array(list(map(len, found)), np.int64) >> 2
        flat, first = np.frombuffer(b"".join(found), np.uint32), np.concatenate(([0], np.cumsum(size)))
        index = coded.indices.to_numpy(zero_copy_only=False)
        n = size[index]
        end = np.cumsum(n)
        kind = np.int32 if len(end) == 0 or end[-1] < 1 << 31 else np.int64
        out = flat[np.arange(end[-1] if len(end) else 0, dtype=kind) + np.repeat((first[index] - (end - n)).astype(kind), n)]
        offsets = split.offsets.to_numpy()
        return out, np.concatenate(([0], end))[offsets - offsets[0]]

    def _whole(self, text: str) -> np.ndarray:
        """The ids of a text of any length, in steps cut at white space."""
        if _ODD.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
        out, at = [], 0
        while at < len(text):
            gap = _GAP.search(text, min(at + STEP, len(text)))
            end = gap.start() if gap else len(text)
            out.append(self._step(pa.array([text[at:end]], pa.string()))[0])
            at = end
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def texts(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, in order; null is as empty."""
        size = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)
        odd = pc.fill_null(pc.match_substring_regex(texts, "[\x1c-\x1f\x85]"), False).to_numpy(zero_copy_only=False)
        for a, z in in_steps(size, STEP):
            if z - a == 1 and size[a] > STEP:
                yield self._whole(texts[a].as_py())
                continue
            ids, at = self._step(texts.slice(a, z - a))
            for i in range(a, z):
                yield self._whole(texts[i].as_py()) if odd[i] else ids[at[i - a] : at[i - a + 1]]

    def ids(self, text: str) -> np.ndarray:
        return next(self.texts(pa.array([text], pa.string())))


def encoder(path: str, memo: int = MEMO) -> Encoder:
    """One encoder a worker process and file, until a task that doesn't encode runs there."""
    have = carry(CACHE)
    if path not in have:
        have[path] = Encoder(path)
    have[path].limit = memo
    return have[path]
