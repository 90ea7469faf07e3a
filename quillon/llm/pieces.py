"""SentencePiece encoding and decoding as a weighted finite-state transducer.

A model is compiled into three machines:

* normaliser: dummy prefix, white-space rules, space -> U+2581 (models with an identity charsmap; others are refused),
* pieces: a trie whose arcs read characters and whose final arcs write a piece,
* byte fallback: for a character that no piece reads, one arc a byte, at the unknown piece's cost.

A text is composed with them and the shortest path in the tropical semiring is its encoding. In a unigram model an arc's weight
is the negated piece score. In a BPE model the weights are the merge order: an arc may follow another only if encoding the two
pieces' text gives these two pieces again, otherwise its weight is infinite. Exactly one finite path exists; it is the one the
merges give. No piece but a run of U+2581 has one past its first character, and no piece joins characters of two alphabets (sets of
characters that stand side by side in pieces), so the lattice falls apart there: parts are solved one by one and a bounded memo
keeps the paths of frequent parts.
"""

from __future__ import annotations

import re
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import bounded, held

SPACE = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Entries of each of the two generations of the memo of solved parts, a worker; some 25 MB each.
MEMO = 120_000
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


class Transducer:
    def __init__(self, model: bytes, memo: int = MEMO):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        spec, self.norm = proto.trainer_spec, proto.normalizer_spec
        if spec.model_type not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models have pieces that compose")
        if self.norm.precompiled_charsmap or not self.norm.escape_whitespaces or spec.treat_whitespace_as_suffix:
            raise ValueError("only identity normalisation with white space as a prefix is compiled")
        self.bpe = spec.model_type == BPE
        self.memo_size = memo
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.follows: dict[int, bool] = {}
        self.pieces = [p.piece for p in proto.pieces]
        self.scores = [p.score for p in proto.pieces]
        self.kinds = [p.type for p in proto.pieces]
        if USER in self.kinds:
            raise ValueError("user-defined pieces are not compiled")
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == NORMAL}
        self.bytes_id = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        self.unk = self.kinds.index(UNKNOWN)
        self.unk_cost = 10.0 - min(self.scores[i] for i in self.ids.values())
        odd = [p for p in self.ids if SPACE in p[1:] and p.strip(SPACE)]
        if odd:
            raise ValueError(f"white space inside a piece: {odd[:3]}")
        self.runs = sorted((len(p) for p in self.ids if not p.strip(SPACE)), reverse=True)
        self.trie: dict = {}
        for p, i in self.ids.items():
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = i
        self.parts = re.compile("|".join([f"[{re.escape(''.join(sorted(x)))}]+" for x in self.alphabets()] + ["."]), re.S)

    def alphabets(self) -> list[set[str]]:
        """Sets of characters between which no piece runs; characters that stand in no longer piece are left out."""
        above: dict[str, str] = {}

        def top(c: str) -> str:
            while above.setdefault(c, c) != c:
                c = above[c]
            return c

        for p in self.ids:
            if len(body := p.lstrip(SPACE)) > 1:
                for c in body:
                    above[top(c)] = top(body[0])
        sets: dict[str, set[str]] = {}
        for c in list(above):
            sets.setdefault(top(c), set()).add(c)
        return sorted(sets.values(), key=len, reverse=True)

    @cached_property
    def surface(self) -> list[bytes]:
        return [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(SPACE, " ").encode() for p, k in zip(self.pieces, self.kinds, strict=True)]

    def merged(self, text: str) -> list[str]:
        """What the merges make of a short string: the best-scored adjacent pair first, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = self.ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.scores[k] > best):
                    best, at = self.scores[k], i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def may_follow(self, a: int, b: int) -> bool:
        if len(self.follows) > 300_000:
            self.follows.clear()
        fits = self.follows[a << 32 | b] = self.merged(self.pieces[a] + self.pieces[b]) == [self.pieces[a], self.pieces[b]]
        return fits

    def fallback(self, c: str) -> list[int]:
        return [self.bytes_id[b] for b in c.encode()] if self.bytes_id else [self.unk]

    def arcs(self, text: str, at: int) -> list[tuple[int, int]]:
        """(end, piece) of all piece arcs out of state `at`, shortest first."""
        node, found = self.trie, []
        for to in range(at, len(text)):
            node = node.get(text[to])
            if node is None:
                break
            i = node.get("")
            if i is not None:
                found.append((to + 1, i))
        return found

    def merge_path(self, text: str) -> list[int]:
        """The finite path of a BPE lattice, by depth-first search that tries long arcs first and enters no dead state twice."""
        n, known, arcs = len(text), self.follows.get, self.arcs
        path: list[int] = []  # pieces
        states: list[int] = [0]  # reached after each of them
        options = [arcs(text, 0)]
        dead: set[tuple[int, int]] = set()
        while True:
            last, left = (path[-1] if path else -1), options[-1]
            while left:
                end, i = left.pop()
                if last >= 0:
                    fits = known(last << 32 | i)
                    if fits is None:
                        fits = self.may_follow(last, i)
                    if not fits:
                        continue
                if dead and (end, i) in dead:
                    continue
                path.append(i)
                if end == n:
                    return path
                states.append(end)
                options.append(arcs(text, end))
                break
            else:
                if not path:
                    raise ValueError(f"no path through {text!r}")
                options.pop()
                dead.add((states.pop(), path.pop()))

    def score_path(self, text: str) -> list[int]:
        """The shortest path of a unigram lattice (states left to right; weights add, the least wins, the longer last arc of equals)."""
        n = len(text)
        cost = [0.0] + [float("inf")] * n
        came: list[tuple[int, int]] = [(-1, -1)] * (n + 1)
        for at in range(n):
            found = self.arcs(text, at)
            for end, i in found:
                if cost[at] - self.scores[i] < cost[end]:
                    cost[end], came[end] = cost[at] - self.scores[i], (at, i)
            if not found or found[0][0] != at + 1:
                if cost[at] + self.unk_cost < cost[at + 1]:
                    cost[at + 1], came[at + 1] = cost[at] + self.unk_cost, (at, -1)
        back, at = [], n
        while at:
            at, i = came[at]
            back.append(self.fallback(text[at])[::-1] if i < 0 else [i])
        return [i for part in reversed([p[::-1] for p in back]) for i in part]

    def solve(self, part: str) -> list[int]:
        """A part without characters to cut at (but a single such character may be the part)."""
        if not self.bpe:
            return self.score_path(part)
        out: list[int] = []
        start = 0
        for k, c in enumerate(part):
            if c not in self.ids:  # read by no piece at all
                if start < k:
                    out += self.merge_path(part[start:k])
                out += self.fallback(c)
                start = k + 1
        return out + self.merge_path(part[start:]) if start < len(part) else out

    def run(self, n: int) -> list[int]:
        """n times U+2581 on their own: their pieces' merges come last and go from the left, the longest piece first."""
        out = []
        for k in self.runs:
            while n >= k:
                out.append(self.ids[SPACE * k])
                n -= k
        return out

    def known(self, part: str) -> bytes:
        got = self.memo.get(part)
        if got is None:
            got = self.older.get(part)
            if got is None:
                got = np.array(self.solve(part), np.int32).tobytes()
            self.keep(part, got)
        return got

    def keep(self, part: str, path: bytes) -> None:
        if len(self.memo) >= self.memo_size:
            self.older, self.memo = self.memo, {}
        self.memo[part] = path

    def word(self, body: str) -> bytes:
        """U+2581 and what follows up to the next."""
        if not self.bpe:
            return self.known(SPACE + body)
        first, *others = self.parts.findall(body)
        if not others:
            return self.known(SPACE + body)
        return b"".join([self.known(SPACE + first), *map(self.known, others)])

    def normalised(self, text: str) -> str:
        text = text.replace(SPACE, " ")
        if self.norm.remove_extra_whitespaces:
            text = re.sub(" +", " ", text).strip(" ")
        return " " + text if text and self.norm.add_dummy_prefix else text

    def encode(self, text: str) -> np.ndarray:
        text = self.normalised(text)
        if not text:
            return np.zeros(0, np.int32)
        first, *words = text.split(" ")
        out = [self.known(first)] if first else []
        get, wait = self.memo.get, 0
        for w in words:
            if not w:
                wait += 1
                continue
            got = get(SPACE + w)
            if got is None:
                got = self.word(w)
            if wait:
                got = self.spaced(wait, got)
                wait = 0
            out.append(got)
        if wait:
            out.append(np.array(self.run(wait), np.int32).tobytes())
        return np.frombuffer(b"".join(out), np.int32)

    def spaced(self, more: int, word: bytes) -> bytes:
        """`more` further U+2581 in front of a word that has one of its own."""
        if int.from_bytes(word[:4], "little") == self.ids[SPACE]:
            more, word = more + 1, word[4:]
        return np.array(self.run(more), np.int32).tobytes() + word

    def decode(self, ids: np.ndarray) -> str:
        surface = self.surface
        text = b"".join([surface[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if self.norm.add_dummy_prefix and text.startswith(" ") else text


def compiled(model: bytes) -> Transducer:
    return held(("pieces", hash(model)), lambda: Transducer(model))


def model_bytes(path: str = MODEL) -> bytes:
    """A model file, read on the driver and sent with the tasks: 0.5 MB here, bounded by the vocabulary."""
    with open(path, "rb") as f:
        return f.read()


def encode(documents: DataFrame, model: str = MODEL, text: str = "text") -> DataFrame:
    """documents with `pieces` struct<ids array<int>, exact boolean> added; exact tells that decoding gives the text again.

    Null texts have no ids (an empty list) and are exact; U+2581 in a text reads as a space, as in the original library, and makes
    it inexact. Texts of any length are encoded whole; repeated rows are encoded each; an empty table gives no rows. Nothing is shuffled.
    Other columns are carried along; `pieces` replaces a column of that name.
    """
    bounded(documents.sparkSession)
    data = model_bytes(model)

    @F.arrow_udf("struct<ids:array<int>,exact:boolean>")
    def pieces(texts: pa.Array) -> pa.Array:
        machine = compiled(data)
        parts, offsets, exact = [], [0], []
        for value in texts:
            s = value.as_py() or ""
            ids = machine.encode(s)
            parts.append(ids)
            offsets.append(offsets[-1] + len(ids))
            exact.append(machine.decode(ids) == s)
        flat = pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32), pa.int32())
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)
        return pa.StructArray.from_arrays([lists, pa.array(exact, pa.bool_())], ["ids", "exact"])

    return documents.withColumn("pieces", pieces(F.col(text)))


def decode(encoded: DataFrame, model: str = MODEL, ids: str = "ids", to: str = "text") -> DataFrame:
    """encoded with the text of its list of ids added; a null list gives a null text."""
    data = model_bytes(model)

    @F.arrow_udf("string")
    def text(lists: pa.Array) -> pa.Array:
        machine = compiled(data)
        return pa.array([machine.decode(np.array(x.as_py(), np.int32)) if x.is_valid else None for x in lists], pa.string())

    return encoded.withColumn(to, text(F.col(ids)))


def op2_sentencepiece(spark, sf_dir: str) -> DataFrame:
    found = encode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", F.size("pieces.ids").cast("long").alias("n_pieces"), F.col("pieces.exact").alias("exact"), F.col("pieces.ids").alias("ids"))
