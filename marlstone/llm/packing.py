"""Sum-of-squares online packing of tokenised documents.

Each task packs the documents of its partition as they come, so nothing is
shuffled and no task needs more than its open windows.  A document's full
windows are cut off; the rest goes to the fill level that makes the sum of the
squared counts of partially filled windows smallest, over a level array with
one count for each LEVEL tokens of fill.  A window with less room than two
levels is done.  When a partition ends, the emptiest windows still open are
taken apart to fill up the others, so each partition leaves at most one
sequence with more padding than that.
"""

from __future__ import annotations

import unicodedata
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import textkit

CAPACITY = 2048
END_ID = 1
#: Tokens of a fill level.
LEVEL = 16
#: How a sequence came about: a document's own full window, a window that its last item closed, or one filled up at the partition's end.
WHOLE, CLOSED, FILLED = "whole", "closed", "filled"

#: Ids of so many words are remembered in a worker, twice: when a table is full it becomes the old one, and what is used again moves over.
REMEMBERED = 800_000
#: So many where another stage needs the room.
FEW = 25_000
#: So many texts are encoded together.
TOGETHER = 128


#: Of the vocabulary file: how a normalised text is cut into pieces.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


class WordEncoder:
    """Token ids by a vocabulary file, word by word, as little-endian unsigned 32-bit values.

    The vocabulary's normaliser and its cutting into pieces never join what white
    space parts, so a word's ids do not depend on what stands beside it.  A new
    word is cut into pieces; new pieces are encoded together, and the tokens that
    end a piece part their ids again.  A text that holds one of the vocabulary's
    added tokens as it stands is encoded whole by the library.
    """

    def __init__(self, path: str) -> None:
        import tokenizers

        self.model = tokenizers.Tokenizer.from_file(path)
        #: The same model for pieces of letters, which are normalised and cut already: only their bytes are mapped.
        self.bare = tokenizers.Tokenizer(self.model.model)
        self.bare.pre_tokenizer = tokenizers.pre_tokenizers.Sequence([tokenizers.pre_tokenizers.WhitespaceSplit(), tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.model.get_vocab()
        #: Tokens that the library looks for in the raw text, before words are cut.
        self.added = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.limit = REMEMBERED
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def cut(self, word: str) -> list[str]:
        plain = word.isascii() or unicodedata.is_normalized("NFC", word) and "Σ" not in word and "İ" not in word
        low = word.lower() if plain else self.model.normalizer.normalize_str(word)
        if low.isalpha():
            return [low]
        if low[:-1].isalpha() and low[-1] in ".,":
            return [low[:-1], low[-1]]
        return _PIECES.findall(low)

    def learn(self, words: list[str]) -> None:
        # Most words are one piece already, letters in lower case of ASCII, and need no list of theirs.
        one = [w for w in words if w.isascii() and w.isalpha()]
        low = " ".join(one).lower().split(" ") if one else []
        words = [w for w in words if not (w.isascii() and w.isalpha())]
        cuts = [self.cut(w) for w in words]
        fresh = list(set(chain(low, *cuts)).difference(self.pieces))
        if fresh:
            if len(self.pieces) > self.limit:
                self.pieces.clear()
                fresh = list(set(chain(low, *cuts)))
            for model, some in ((self.bare, [p for p in fresh if p.isalpha()]), (self.model, [p for p in fresh if not p.isalpha()])):
                ids = np.array(model.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
                stops = np.flatnonzero(self.ends[ids]) + 1
                if len(stops) != len(some):
                    parts = [np.array(e.ids, "<u4").tobytes() for e in model.encode_batch_fast(some, add_special_tokens=False)]
                else:
                    raw, at = ids.tobytes(), [0, *(4 * stops).tolist()]
                    parts = [raw[x:y] for x, y in zip(at, at[1:], strict=False)]
                self.pieces.update(zip(some, parts, strict=True))
        pieces = self.pieces
        self.known.update(zip(one, map(pieces.__getitem__, low), strict=True))
        for w, c in zip(words, cuts, strict=True):
            self.known[w] = pieces[c[0]] if len(c) == 1 else pieces[c[0]] + pieces[c[1]] if len(c) == 2 else b"".join([pieces[p] for p in c])

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of some texts, whose new words are learned together."""
        whole = {k: self.model.encode(t, add_special_tokens=False).ids for k, t in enumerate(texts) if any(a in t for a in self.added)}
        cut = [[""] if k in whole else t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for k, t in enumerate(texts)]
        if len(self.known) > self.limit:
            self.known, self.old = {}, self.known
        known, old = self.known, self.old
        new = set().union(*cut).difference(known)
        if old:
            known.update([(w, old[w]) for w in new if w in old])
            new = new.difference(old)
        if new:
            self.learn(list(new))
        return [np.array(whole[k], "<u4").tobytes() if k in whole else b"".join(map(known.__getitem__, words)) for k, words in enumerate(cut)]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a file: Spark reuses workers, so later tasks need not read it again."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


class SumOfSquares:
    """Open windows by fill level, and the level array of their counts; level k holds fills over ``(k - 1) * level`` up to ``k * level``."""

    def __init__(self, capacity: int = CAPACITY, level: int = LEVEL) -> None:
        self.capacity, self.size = capacity, level
        self.top = capacity // level
        self.room = max(capacity - self.top * level, 0) + 2 * level - 1
        self.level = np.zeros(self.top + 1, np.int64)
        self.windows: list[list[tuple[int, list]]] = [[] for _ in range(self.top + 1)]

    def place(self, item, size: int) -> list | None:
        """Put an item of ``size`` < capacity into a window; the window's items if that leaves it with too little room for more.

        The change of the sum of squares by moving a window from level h to h + s
        is 2 (level[h + s] - level[h] + 1), without the first term if it gets
        done; a new window costs 2 level[s] + 1.  Ties go to the fullest window.
        """
        if self.capacity - size < self.room:
            return [item]
        n, c = self.level, self.top
        s = -(-size // self.size)
        cost = 2 * (n[s:] - n[: c - s + 1] + 1)
        cost[-1] = 1 - 2 * n[c - s]
        cost[0] = 2 * n[s] + 1
        open_ = n[: c - s + 1] > 0
        open_[0] = True
        h = c - s - int(np.where(open_, cost, np.iinfo(np.int64).max)[::-1].argmin())
        fill, window = self.windows[h].pop() if h else (0, [])
        if h:
            n[h] -= 1
        window.append(item)
        fill += size
        if self.capacity - fill < self.room:
            return window
        h = -(-fill // self.size)
        n[h] += 1
        self.windows[h].append((fill, window))
        return None

    def rest(self) -> list[tuple[int, list]]:
        """Fill and items of all windows still open, the fullest first."""
        out = sorted((w for level in self.windows for w in level), key=lambda w: -w[0])
        self.__init__(self.capacity, self.size)
        return out


def pack(documents, capacity: int = CAPACITY, level: int = LEVEL):
    """Sequences, each how it came about and a list of (document, start, ids), of documents given as (document, ids) one by one."""
    packer = SumOfSquares(capacity, level)
    for doc, ids in documents:
        full = len(ids) // capacity * capacity
        for at in range(0, full, capacity):
            yield WHOLE, [(doc, at, ids[at : at + capacity])]
        if len(ids) > full:
            done = packer.place((doc, full, ids[full:]), len(ids) - full)
            if done:
                yield CLOSED, done
    rest = packer.rest()
    keep = -(-sum(fill for fill, _ in rest) // capacity)
    loose = [i for _, window in reversed(rest[keep:]) for i in window]
    for fill, window in rest[:keep]:
        room = capacity - fill
        while room and loose:
            doc, start, ids = loose.pop()
            window.append((doc, start, ids[:room]))
            if len(ids) > room:
                loose.append((doc, start + room, ids[room:]))
            room -= min(room, len(ids))
        yield FILLED, window


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True, remember: bool = False) -> DataFrame:
    """One row per piece: ``id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``, ``made`` and, unless turned off, ``ids``.

    A null or empty text is the end id alone.  Rows with equal or null ids are
    packed each for itself.  Extra columns are ignored; an empty table gives an
    empty result.  ``sequence_id`` is unique over the result: the partition's
    number and a count within it.  With ``remember`` a worker keeps the ids of
    words, up to twice REMEMBERED of them, for its later tasks; without, twice FEW
    in a task and neither words nor vocabulary behind it, and another stage gets
    the room.
    """
    fields = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, made string" + (", ids array<int>" if with_ids else "")
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "made", "ids"][: 9 if with_ids else 8]

    def rows(batches):
        words = encoder(tokenizer_path)
        words.limit = REMEMBERED if remember else FEW
        end = np.array([end_id], "<u4").tobytes()
        base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40

        def documents():
            for b in batches:
                for at in range(0, len(b), TOGETHER):
                    part = b.slice(at, TOGETHER)
                    encoded = words.encode_all([t or "" for t in part.column(1).to_pylist()])
                    for key, raw in zip(part.column(0).to_pylist(), encoded, strict=True):
                        ids = np.frombuffer(raw + end, "<u4")
                        yield (key, len(ids)), ids

        held: list[tuple] = []

        def batch():
            cols = list(zip(*held, strict=True))
            arrays = [*(pa.array(c, pa.int64()) for c in cols[:7]), pa.array(cols[7], pa.string())]
            if with_ids:
                arrays.append(pa.array([x.view(np.int32) for x in cols[8]], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(arrays, names)

        for k, (made, sequence) in enumerate(pack(documents(), capacity)):
            at = 0
            for (key, total), start, ids in sequence:
                held.append((key, start, len(ids), zlib.crc32(ids), total, base + k, at, made, ids if with_ids else None))
                at += len(ids)
            if len(held) > 4000:
                yield batch()
                held.clear()
        if held:
            yield batch()
        if not remember:
            _encoders.pop(tokenizer_path, None)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(textkit.tidy(rows), fields)
