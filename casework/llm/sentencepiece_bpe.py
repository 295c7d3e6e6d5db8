"""Exact merge-type SentencePiece encoding by backtracking, and decoding.

A sequence of pieces is the encoding of a text exactly when every two neighbours, taken
alone, are merged into the same two pieces: merges within two neighbours happen in the
same order there as in the whole text. One pass of an Aho-Corasick automaton finds all matches
and so the longest piece at every position. The encoder goes from left to right, takes the
longest piece, accepts it only if it is compatible with the piece before it, and steps back
where none is; a bitfield remembers positions from which no way leads on, so every position
fails once at most. Compatibility is tested by merging the two pieces' characters again.

Texts are first cut where no piece can reach across, for example before every space. The
parts repeat, so a worker keeps the results of a bounded number of them, from one task to the
next.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import of_worker, release, slices

#: Entries that a worker keeps of parts and of pairs; beyond them it forgets what it has not needed for long. Longer parts are not kept.
CACHE_PARTS = 600_000
CACHE_PAIRS = 300_000
CACHE_CHARS = 40
META = "▁"  # stands for a space
NO_SCORE = float("-inf")


class _Bounded(dict):
    """A dictionary that computes what it lacks and holds a bounded number of entries, of bounded keys where ``chars`` is given.

    Half of the entries are those asked for since it was last half full, the others those asked for in the time before.
    """

    def __init__(self, make, most: int, chars: int | None = None, key=None):
        """``key`` gives an equal key of less memory, by which an entry is kept."""
        self.make, self.most, self.chars, self.key, self.before = make, most // 2, chars, key, {}

    def __missing__(self, key):
        value = self.before.get(key)
        if value is None:
            value = self.make(key)
            if self.chars and len(key) > self.chars:
                return value
        if len(self) >= self.most:
            self.before = dict(self)
            self.clear()
        self[self.key(key) if self.key else key] = value
        return value


class PieceEncoder:
    """Encodes with the vocabulary of a SentencePiece model of the BPE type with byte fallback."""

    def __init__(self, model: str):
        import ahocorasick
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(model, "rb") as f:
            proto.ParseFromString(f.read())
        norm, train = proto.normalizer_spec, proto.trainer_spec
        if train.model_type != 2 or not train.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only BPE models with byte fallback and identity normalisation are supported")
        if any(p.type in (4, 5) for p in proto.pieces):
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        self.prefix = META if norm.add_dummy_prefix else ""
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        self.scores = {p.piece: p.score for p in proto.pieces if p.type == 1}
        self.bytes = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        #: From every piece to the longest shorter piece that begins it; where a character outside the vocabulary begins it, that character stands before all of them too.
        self.shorter: dict[str, str] = {}
        for piece in self.ids:
            self.automaton.add_word(piece)
            self.shorter[piece] = next((piece[:n] for n in range(len(piece) - 1, 0, -1) if piece[:n] in self.ids), piece[0] if len(piece) > 1 else "")
        self.automaton.make_automaton()
        self.parts = re.compile(self._parts([p for p in self.ids if len(p) > 1])).findall
        own = {piece: piece for piece in self.ids}
        self.compatible = _Bounded(self._compatible, CACHE_PAIRS, key=lambda pair: (own.get(pair[0], pair[0]), own.get(pair[1], pair[1])))
        #: A part's ids as bytes, a fraction of a tuple's memory.
        self.kind = "H" if self.library.get_piece_size() <= 1 << 16 else "I"
        self.encoded = _Bounded(self._encode_part, CACHE_PARTS, CACHE_CHARS)

    def _parts(self, longer: list[str]) -> str:
        """A pattern of parts that no piece reaches across: a word or a run of punctuation, each with the space marks before it."""
        if any(META in p.lstrip(META) for p in longer):
            raise ValueError("a piece reaches across a space")
        inner, neighbours = set().union(*longer), {(a, b) for p in longer for a, b in zip(p, p[1:])}
        ascii_ = {chr(c) for c in range(128)} - {" "}
        alone = ascii_ - inner
        marks = {c for c in inner if not (c.isalpha() or c.isdecimal())} - {META}
        while True:  # keep those that no piece joins with anything but each other and spaces
            kept = {c for c in marks if not any((a == c and b not in marks) or (b == c and a not in marks and a != META) for a, b in neighbours)}
            if kept == marks:
                break
            marks = kept
        some = lambda chars: "".join(map(re.escape, sorted(chars)))
        patterns = [f" *[^ {some(alone | marks)}]+"]
        if marks:
            patterns.append(f" *[{some(marks)}]+")
        patterns.append(" +")
        if alone:
            patterns.append(f"[{some(alone)}]")
        return "|".join(patterns)

    def merge(self, text: str) -> list[str]:
        """The model's own rule: again and again merge the neighbours whose piece has the best score, the leftmost of equals."""
        symbols, score, none = list(text), self.scores.get, NO_SCORE
        pairs = [score(a + b, none) for a, b in zip(symbols, symbols[1:])]
        while pairs and (best := max(pairs)) > none:
            at = pairs.index(best)
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = score(symbols[at - 1] + symbols[at], none)
            if at < len(pairs):
                pairs[at] = score(symbols[at] + symbols[at + 1], none)
        return symbols

    def _longest(self, part: str) -> list[int]:
        """For every position the length of the longest piece that begins there; a character outside the vocabulary stands for itself."""
        longest = [1] * len(part)
        for end, length in self.automaton.iter(part):
            if length > longest[end + 1 - length]:
                longest[end + 1 - length] = length
        return longest

    def _compatible(self, pair: tuple[str, str]) -> bool:
        """Are the two merged into just these two? Nothing before the second one stands for the beginning of the text."""
        whole = "".join(pair)
        if not pair[0]:
            return self.merge(whole) == [whole]
        # Where the two are a piece together, merging can't end with them.
        return whole not in self.scores and self.merge(whole) == list(pair)

    def pieces(self, part: str) -> list[str]:
        """Backtracking over the longest matches."""
        n, shorter, compatible, longest = len(part), self.shorter.get, self.compatible, self._longest(part)
        failed, any_failed = bytearray(n // 8 + 1), False  # a bit for each position
        out: list[str] = []
        pos, last, piece = 0, "", part[: longest[0]]
        while pos < n:
            while piece:
                end = pos + len(piece)
                if compatible[last, piece] and not (any_failed and failed[end >> 3] >> (end & 7) & 1):
                    break
                piece = shorter(piece, "")
            if piece:
                out.append(piece)
                pos, last = end, piece
                if pos < n:
                    piece = part[pos : pos + longest[pos]]
            else:
                failed[pos >> 3] |= 1 << (pos & 7)
                any_failed = True
                piece = out.pop()
                pos -= len(piece)
                piece, last = shorter(piece, ""), out[-1] if out else ""
        return out

    def _encode_part(self, part: str) -> bytes:
        pieces, ids = self.pieces(part.replace(" ", META)), self.ids
        try:
            found = [ids[piece] for piece in pieces]
        except KeyError:
            found = list(chain.from_iterable((ids[p],) if p in ids else (self.bytes[b] for b in p.encode()) for p in pieces))
        return array(self.kind, found).tobytes()

    def encode(self, text: str) -> list[int]:
        """The ids of a text. Parts have spaces for the marks, which mean the same: with a mark in it every character of a part would take two bytes."""
        if not text:
            return []
        return array(self.kind, b"".join(map(self.encoded.__getitem__, self.parts((self.prefix + text).replace(META, " "))))).tolist()


#: What :func:`tokenize` can return, and the types.
OUTPUTS = {"n_tokens": "long", "ids": "array<int>", "ids_sha256": "string", "decoded": "string", "decoded_sha256": "string"}
_ARROW = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "ids_sha256": pa.string(), "decoded": pa.string(), "decoded_sha256": pa.string()}


def _of_worker(model: str) -> PieceEncoder:
    """The encoder of this Python worker, with its caches, for the task at hand. Tasks of a worker come one after the other and meet the same words."""
    kept = of_worker()
    if kept.get("model") != model:
        release()  # what tasks of other stages have left
        kept.update(model=model, encoder=PieceEncoder(model))
    return kept["encoder"]


def _tokenizer(model: str, outputs: tuple[str, ...]):
    def run(batches):
        encoder = _of_worker(model)
        decode, decimal = encoder.library.decode, [str(i) for i in range(encoder.library.get_piece_size())].__getitem__
        for batch in slices(batches):
            values = {name: [] for name in outputs}
            for text in batch.column("text"):
                ids = encoder.encode(text.as_py())
                decoded = decode(ids) if "decoded" in values or "decoded_sha256" in values else None
                for name, add in values.items():
                    if name == "n_tokens":
                        add.append(len(ids))
                    elif name == "ids":
                        add.append(pa.array(ids, pa.int32()))
                    elif name == "ids_sha256":
                        add.append(hashlib.sha256(",".join(map(decimal, ids)).encode()).hexdigest())
                    elif name == "decoded":
                        add.append(decoded)
                    else:
                        add.append(hashlib.sha256(decoded.encode()).hexdigest())
            kept = {c: batch.column(c) for c in batch.schema.names if c != "text"}
            yield pa.record_batch(kept | {name: pa.array(v, _ARROW[name]) for name, v in values.items()})
        release()

    return run


def tokenize(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = tuple(OUTPUTS), keep: tuple[str, ...] = ()) -> DataFrame:
    """Encode every text and decode it again: ``id_col``, the columns in ``keep``, and the ``outputs`` asked for.

    ``model`` is the path of a SentencePiece model file that every executor has; by default
    the public 32k BPE model. Ids have no begin or end mark. A null or empty text has no
    ids and decodes to an empty text. Repeated rows and null ids are kept as they are. The
    work is one pass without a shuffle, in memory bounded by a batch and the two caches.
    Other columns are ignored, whatever their names.
    """
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("piece_bpe_32k.model")
    names = list(dict.fromkeys([id_col, *keep]))
    hidden = [f"c{i}" for i in range(len(names))]
    types_ = dict(docs.dtypes)
    rows = docs.select(*(F.col(n).alias(h) for n, h in zip(names, hidden)), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    schema = ", ".join([f"{h} {types_[n]}" for n, h in zip(names, hidden)] + [f"{o} {OUTPUTS[o]}" for o in outputs])
    return rows.mapInArrow(_tokenizer(str(model), tuple(outputs)), schema).select(*(F.col(h).alias(n) for n, h in zip(names, hidden)), *outputs)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize(spark.read.parquet(f"{sf_dir}/documents.parquet"), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))
