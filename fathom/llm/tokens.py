"""Token ids of whole texts, by a public tokenizer, with a cache of what stands between spaces."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_encoders: dict[tuple[str, int], ChunkEncoder | PlainEncoder | RankCounter] = {}

#: Marks that the tokenizer parts from a letter before them; no apostrophe and no part of a special token.
MARKS = b".,;:!?*#$%&()[]{}\"/"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_MARK, _LETTER, _ODD = (np.zeros(256, dtype=bool) for _ in range(3))
_MARK[list(MARKS)] = True
_LETTER[list(b"abcdefghijklmnopqrstuvwxyz")] = True
_ODD[[ord("<"), 0xCC, 0xCD]] = True  # special tokens, and accents that compose with the letter before


WORDS, BYTES = "word_bpe_49k.json", "byte_bpe_50k.tiktoken"
#: How the tokenizer that ``ChunkEncoder`` is made for prepares a text.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def default_path() -> str:
    return public_path(WORDS)


def _prepared(texts: pa.Array) -> pa.Array:
    """Texts with the same ids and fewer distinct chunks: plain letters in lower case, and a space before marks behind a letter.

    A text with an odd byte stays as it is, but for its line feeds, which become spaces in all.
    """
    n = len(texts)
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    if not n or texts.buffers()[2] is None:
        return texts
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[bounds[0] : bounds[-1]]
    bounds -= bounds[0]
    data = _LOWER[raw]
    accented = np.flatnonzero(raw[:-1] == 0xC3) + 1
    low = accented[(raw[accented] <= 0x9E) & (raw[accented] != 0x97)]
    data[low] += 32
    ends = _LETTER[data]
    ends[accented] = (data[accented] != 0x97) & (data[accented] != 0xB7)
    cuts = np.flatnonzero(ends[:-1] & _MARK[data[1:]]) + 1
    if len(odd := np.flatnonzero(_ODD[raw])):
        kept = np.unique(np.searchsorted(bounds, odd, side="right") - 1)
        for k in kept.tolist():
            data[bounds[k] : bounds[k + 1]] = raw[bounds[k] : bounds[k + 1]]
        cuts = cuts[~np.isin(np.searchsorted(bounds, cuts, side="right") - 1, kept)]
    data[data == 0x0A] = 0x20
    # A cut between two texts would do no harm; each space counts to the text that holds the mark.
    moved = bounds + np.searchsorted(cuts, bounds, side="left")
    return pa.StringArray.from_buffers(n, pa.py_buffer(moved.astype(np.int32)), pa.py_buffer(np.insert(data, cuts, 0x20)))


class ChunkEncoder:
    """Encodes texts with the tokenizer in the file ``path``, which must drop spaces and line feeds and mark word ends.

    No token of such a tokenizer reaches over a space, so the ids of a text are
    those of its chunks between spaces, one after the other. Each chunk is encoded
    once and kept; of ``max_entries`` chunks the half that was used last stays.
    """

    def __init__(self, path: str, max_entries: int = 300_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.closes = np.array([(self.tokenizer.id_to_token(k) or "").endswith("</w>") for k in range(size)])
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.max_entries = max_entries

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk. Words of plain letters are encoded many at a time: each ends where a token closes a word."""
        found: dict[str, bytes] = {}
        words = [c for c in chunks if c.isalpha() and (c.isascii() or max(c) < "İ")]
        for i in range(0, len(words), 4096):
            group = words[i : i + 4096]
            lines = self._encode([" ".join(group[k : k + 64]) for k in range(0, len(group), 64)])
            ids = np.fromiter((x for line in lines for x in line), dtype="<u4")
            ends = (np.flatnonzero(self.closes[ids]) + 1).tolist()
            if len(ends) == len(group):
                data, at = ids.tobytes(), 0
                for word, end in zip(group, ends, strict=True):
                    found[word] = data[4 * at : 4 * end]
                    at = end
        rest = [c for c in chunks if c not in found]
        for i in range(0, len(rest), 4096):
            group = rest[i : i + 4096]
            found.update(zip(group, (array("I", ids).tobytes() for ids in self._encode(group)), strict=True))
        return [found[c] for c in chunks]

    def _ids(self, chunks: list[str]) -> list[bytes]:
        """chunks: distinct."""
        if len(self.young) > self.max_entries // 2:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        out = [young.get(c) for c in chunks]
        missing = [k for k, ids in enumerate(out) if ids is None]
        unknown = []
        for k in missing:
            if (ids := old.get(chunks[k])) is None:
                unknown.append(k)
            else:
                out[k] = ids
        for k, ids in zip(unknown, self._learn([chunks[k] for k in unknown]), strict=True):
            out[k] = ids
        young.update((chunks[k], out[k]) for k in missing)
        return out

    def encode(self, texts: pa.Array, eos: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by eos, and where each text's begin (one more than texts)."""
        n = len(texts)
        lists = pc.split_pattern(_prepared(pc.fill_null(texts, "")), " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.flatten().dictionary_encode()
        index = flat.indices.to_numpy()
        parts = self._ids(flat.dictionary.to_pylist())
        table = np.frombuffer(b"".join(parts), dtype="<u4")
        lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // 4
        kind = np.int32 if lengths[index].sum() + n < 1 << 31 and lengths.sum() < 1 << 31 else np.int64  # half the memory
        begins = np.concatenate(([0], np.cumsum(lengths)))[:-1].astype(kind)
        sizes = lengths[index]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        bounds = ends[offsets - offsets[0]] if n else np.zeros(1, dtype=np.int64)
        total = int(ends[-1])
        take = np.repeat(begins[index] - ends[:-1].astype(kind), sizes)
        take += np.arange(total, dtype=kind)
        out = np.empty(total + n, dtype="<u4")
        place = np.repeat(np.arange(n, dtype=kind), np.diff(bounds))
        place += np.arange(total, dtype=kind)
        out[place] = table[take]
        starts = bounds + np.arange(n + 1)
        out[starts[1:] - 1] = eos
        return out, starts


class PlainEncoder:
    """Encodes whole texts with any file for the tokenizers library."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def encode(self, texts: pa.Array, eos: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by eos, and where each text's begin (one more than texts)."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(pc.fill_null(texts, "").to_pylist(), add_special_tokens=False)]
        starts = np.concatenate(([0], np.cumsum([len(ids) + 1 for ids in found], dtype=np.int64)))
        return np.fromiter((x for ids in found for x in (*ids, eos)), dtype="<u4", count=int(starts[-1])), starts


class RankCounter:
    """Counts tokens with a file of ranks for the tiktoken library, in parts of a text that no token reaches over."""

    PART, RUN = 1 << 20, 4096

    def __init__(self, path: str):
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._cut = re.compile(r"(?<=[^\W_]) (?=[^\W_])")
        self._run = re.compile(rf"\s{{{self.RUN},}}(?=\s)|\s{{{self.RUN},}}\Z")

    def _count(self, text: str) -> int:
        """Of a text without long runs of blanks; a blank between two words begins a token."""
        n = at = 0
        while len(text) - at > self.PART and (m := self._cut.search(text, at + self.PART)):
            n += len(self.encoding.encode_ordinary(text[at : m.start()]))
            at = m.start()
        return n + len(self.encoding.encode_ordinary(text[at:] if at else text))

    def __call__(self, text: str) -> int:
        if len(text) < self.RUN or not (m := self._run.search(text)):
            return self._count(text)
        n = at = 0
        while m:
            # All of a run but its last blank before a word is one piece.
            n += self._count(text[at : m.start()]) + len(self.encoding._encode_single_piece(m[0].encode()))
            at = m.end()
            m = self._run.search(text, at)
        return n + self._count(text[at:])


def _made_for_chunks(path: str) -> bool:
    import json

    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    before = (d.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    split = before[0].get("pattern"), before[0].get("behavior"), before[0].get("invert")
    added = all(t["content"].startswith("<") and not t["normalized"] for t in d.get("added_tokens") or [])
    return (
        (d.get("normalizer") or {}).get("normalizers") == NORMALIZER and split == ({"Regex": SPLIT}, "Removed", True) and added
        and d["model"].get("end_of_word_suffix") == "</w>"
    )


def encoder(path: str, max_entries: int = 300_000) -> ChunkEncoder | PlainEncoder:
    """One for each file and process: workers keep it from task to task. Other tokenizers than ``ChunkEncoder``'s kind encode whole texts."""
    if (path, max_entries) not in _encoders:
        _encoders[path, max_entries] = ChunkEncoder(path, max_entries) if _made_for_chunks(path) else PlainEncoder(path)
    return _encoders[path, max_entries]


def counts(path: str, texts: pa.Array) -> np.ndarray:
    """Tokens of each text by a file for the tokenizers library or, named ``.tiktoken``, one of ranks."""
    if path.endswith(".tiktoken"):
        if (path, 0) not in _encoders:
            _encoders[path, 0] = RankCounter(path)
        return np.fromiter((_encoders[path, 0](t) if t else 0 for t in texts.to_pylist()), dtype=np.int64, count=len(texts))
    return np.diff(encoder(path).encode(texts, 0)[1]) - 1


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 3 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts a batch between rows so that the texts of a slice have about most_bytes at most."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < batch.num_rows:
        k = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most_bytes, side="right")))
        yield batch.slice(i, k - i)
        i = k
