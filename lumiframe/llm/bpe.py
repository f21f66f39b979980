"""Byte-pair encoding and decoding with a pair occurrence index.

A partition is encoded in bounded runs, one per Arrow batch: the pretokens of a run that the worker doesn't remember are
encoded together. An index maps each pair of neighbouring symbols to all its positions in the run, a heap gives the
pairs that have a rank in ascending order, and merging a pair's positions updates the lists of the pairs beside it.
All positions of a rank are merged before the next rank. That equals merging pretoken by pretoken as long as every token
is made by one merge only; files in which two merges make one token are refused.
"""

from __future__ import annotations

import functools
import heapq
import json
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lumiframe.llm.common import text_bytes, with_columns_from

#: Pretokens whose ids a worker remembers before it turns to a new set, and keeps of the old one what is asked for.
MOST_REMEMBERED = 100_000
#: Fixed values of the byte-level format: contractions, and the code points that count as white space.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else the next code point from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


def refuse(d: dict) -> None:
    """Raise for what a tokenizer file may ask for and this encoder doesn't do."""
    model = d["model"]
    if d.get("normalizer") is not None:
        raise ValueError("normalizers aren't supported")
    if model.get("type", "BPE") != "BPE" or any(model.get(k) for k in ("ignore_merges", "dropout", "fuse_unk", "byte_fallback", "continuing_subword_prefix", "end_of_word_suffix")):
        raise ValueError("only plain byte-pair models are supported")
    # `normalized` says nothing where there is no normalizer
    if any(t.get(k) for t in d["added_tokens"] for k in ("lstrip", "rstrip", "single_word")):
        raise ValueError("added tokens that strip spaces or match single words aren't supported")


class Vocabulary:
    """Merges and tokens of a byte-level BPE tokenizer file in JSON."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        refuse(d)
        ids = d["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in d["added_tokens"]}
        self.size = max([*ids.values(), *self.added.values()], default=0) + 1
        symbols = byte_symbols()
        self.byte_ids = [ids.get(s) for s in symbols]
        back = {s: b for b, s in enumerate(symbols)}
        self.token_bytes: list[bytes] = [b""] * self.size
        for t, i in chain(ids.items(), self.added.items()):
            self.token_bytes[i] = bytes(back[c] for c in t) if all(c in back for c in t) else t.encode()
        #: pair of ids as one number -> (rank, id of the merged token); the stride leaves room for marks of -1 and -2
        self.stride = self.size + 2
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, m in enumerate(d["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.merges[ids[a] * self.stride + ids[b]] = (rank, ids[a + b])
        if len({token for _, token in self.merges.values()}) < len(d["model"]["merges"]):
            raise ValueError("a token that two merges make")
        self.pair_array = np.array(sorted(self.merges), dtype=np.int64)
        self.byte_array = np.array([-1 if i is None else i for i in self.byte_ids], dtype=np.int64)


class Encoder:
    def __init__(self, vocabulary: Vocabulary, special: bool = True):
        """special: strings of added tokens become those tokens; else they are ordinary text."""
        import re

        import regex

        self.v = vocabulary
        # ids as int32, far smaller than lists of numbers; what no batch has asked for since the last turn is forgotten
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        body = rf" ?%s+| ?%s+| ?[^{SPACES}%s]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
        self.plain = re.compile(f"{CONTRACTIONS}|" + body % ("[A-Za-z]", "[0-9]", "A-Za-z0-9"))
        self.general = regex.compile(f"{CONTRACTIONS}|" + body % (r"\p{L}", r"\p{N}", r"\p{L}\p{N}"))
        added = sorted(vocabulary.added, key=lambda t: (-len(t), t))
        self.special = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added and special else None

    def pretokens(self, text: str) -> list[str]:
        """Pieces of a text that merges don't cross; strings of added tokens are pieces of their own."""
        find = (self.plain if text.isascii() else self.general).findall
        if self.special is None or not self.special.search(text):
            return find(text)
        return [t for i, part in enumerate(self.special.split(text)) for t in ([part] if i % 2 else find(part))]

    def learn(self, new: list[str]) -> None:
        """Encode pretokens together and remember them."""
        v, stride, merges = self.v, self.v.stride, self.v.merges
        todo = []
        for t in new:
            if self.special is not None and t in v.added:
                self.known[t] = array("i", [v.added[t]]).tobytes()
            else:
                todo.append(t)
        encoded = [t.encode() for t in todo]
        # a byte's symbol each, with -1 before the first pretoken and after every one
        starts = np.cumsum([1, *[len(b) + 1 for b in encoded]])
        flat = np.full(starts[-1], -1, np.int64)
        inside = np.ones(len(flat), bool)
        inside[0] = False
        inside[starts[1:] - 1] = False
        flat[inside] = v.byte_array[np.frombuffer(b"".join(encoded), np.uint8)]
        # the index: for each pair that has a rank, its places in ascending order
        pairs = flat[:-1] * stride + flat[1:]
        at = np.searchsorted(v.pair_array, pairs)
        hit = np.flatnonzero(v.pair_array.take(at, mode="clip") == pairs)
        hit = hit[np.argsort(at[hit], kind="stable")]
        cuts = np.flatnonzero(np.diff(pairs[hit])) + 1
        places: dict[int, list[int]] = {int(pairs[x[0]]): x.tolist() for x in np.split(hit, cuts) if len(x)}
        symbols = flat.tolist()
        n = len(symbols)
        after = list(range(1, n + 1))  # the next live symbol; a merged one's right half becomes -2
        before = list(range(-1, n - 1))
        active = [(merges[p][0], p) for p in places]
        heapq.heapify(active)
        find, push = places.get, heapq.heappush
        while active:
            _, pair = heapq.heappop(active)
            a, b = divmod(pair, stride)
            merged = merges[pair][1]
            base = merged * stride
            own = places.pop(pair)
            own.sort()
            for i in own:
                j = after[i]
                if symbols[i] != a or symbols[j] != b:
                    continue
                symbols[i], symbols[j] = merged, -2
                k = after[i] = after[j]
                h = before[i]
                before[k] = i
                beside = symbols[h] * stride + merged
                if beside in merges:
                    if (list_ := find(beside)) is not None:
                        list_.append(h)
                    else:
                        places[beside] = [h]
                        push(active, (merges[beside][0], beside))
                beside = base + symbols[k]
                if beside in merges:
                    if (list_ := find(beside)) is not None:
                        list_.append(i)
                    else:
                        places[beside] = [i]
                        push(active, (merges[beside][0], beside))
        ends = starts.tolist()
        known = self.known
        for t, s, e in zip(todo, ends, ends[1:], strict=False):
            known[t] = array("i", [x for x in symbols[s : e - 1] if x >= 0]).tobytes()

    def flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each has."""
        pieces = [self.pretokens(t) for t in texts]
        if len(self.known) > MOST_REMEMBERED:
            self.before, self.known = self.known, {}
        known, before = self.known, self.before
        if new := {t for p in pieces for t in p if t not in known}:
            seen = new.intersection(before)
            known.update((t, before[t]) for t in seen)
            self.learn(sorted(new - seen))
        get = self.known.__getitem__
        parts = [b"".join(map(get, p)) for p in pieces]
        return np.frombuffer(b"".join(parts), np.int32), np.array([len(p) // 4 for p in parts], np.int64)

    def __call__(self, texts: list[str]) -> list[list[int]]:
        ids, sizes = self.flat(texts)
        return [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] if len(sizes) else []


@functools.lru_cache(2)
def shared_encoder(vocabulary: str, special: bool = True) -> Encoder:
    """The encoder of this worker process: what it remembers serves its later tasks too."""
    return Encoder(Vocabulary(vocabulary), special)


def encode(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with the token ids of each whole text; a null or empty text has none.

    The ids are those of the vocabulary file's own library without added special tokens, truncation and padding;
    strings of the vocabulary's added tokens within a text become those tokens. vocabulary is a path that every
    executor has. A column named as `ids` is replaced.
    """

    def make():
        encoder = shared_encoder(vocabulary)

        def work(column: pa.Array):
            ids, sizes = encoder.flat([b.decode("utf-8", "replace") for b in text_bytes(column)])
            return [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(ids))]

        return work

    return with_columns_from(df, [text], make, [T.StructField(ids, T.ArrayType(T.IntegerType()))])


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with the text of each list of ids, special tokens included; no ids or null is an empty text, unknown ids are left out.

    Bytes that aren't UTF-8 become U+FFFD. A column named as `text` is replaced.
    """

    def make():
        tokens = shared_encoder(vocabulary).v.token_bytes
        lengths = np.array([*map(len, tokens)], dtype=np.int64)
        flat = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        starts = np.cumsum(lengths) - lengths

        def work(column: pa.Array):
            out = []
            for row in range(len(column)):
                x = column[row].values
                x = np.asarray(x.drop_null() if x is not None else [], dtype=np.int64)
                x = x[(x >= 0) & (x < len(tokens))]
                size = lengths[x]
                ends = np.cumsum(size)
                total = int(ends[-1]) if len(ends) else 0
                # the place of each byte in `flat`: its token's start plus its place in the token
                place = np.repeat(starts[x] - ends + size, size) + np.arange(total)
                out.append(flat[place].tobytes().decode("utf-8", "replace"))
            return [pa.array(out, type=pa.string())]

        return work

    return with_columns_from(df, [ids], make, [T.StructField(text, T.StringType())])
