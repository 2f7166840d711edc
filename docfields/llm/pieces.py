"""SentencePiece encoding and decoding as a weighted transducer.

A model file compiles to three machines: the normaliser (white space to the mark U+2581, a leading mark), the lexicon of
pieces, and byte fallback for characters that no piece has. Composed with a text they give a lattice: states are places
in the text, arcs are pieces. The encoding is the shortest path in the tropical semiring (minimum of sums):

* unigram models: an arc costs minus the piece's score;
* merge (BPE) models: the state also holds the last piece. An arc costs 0 if the pair (last piece, piece) is what merging
  makes of the two strings, else infinity. Exactly one path of finite cost is left, and it is the merge encoding, so
  ids equal those of the library.

Lattices are cut where no piece can cross (before a run of marks; around characters without pieces), and the path of each
distinct cut is remembered per task up to a bound; memory follows the longest text, never the corpus. Pieces of a cut are taken over
whole texts, long ones included.

Null text: null ids and null token count. Empty text: no ids. A literal U+2581 decodes as a space. Other columns are kept by `encode`;
clashing names are replaced.
"""

from __future__ import annotations

import re
import struct
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docfields.llm.common import map_rows, table

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
#: Distinct cuts that a worker remembers, in each of two generations.
REMEMBERED = 500_000
#: Letters without superscripts, and marks that often follow them.
LETTER, PUNCTUATION = "[^\\W\\d_²³¹]", ".,;:!?()\"'#$%&*|/=-"
#: Stands for a character that is spelt in bytes.
SPELT = -2


def _fields(data: bytes):
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value, at
            shift += 7

    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size, at = (8, at) if kind == 1 else (4, at) if kind == 5 else varint(at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class Machine:
    """The compiled model; plain dictionaries and lists, so it travels to tasks as data."""

    def __init__(self, data: bytes):
        self.pieces, self.scores, self.kinds = [], [], []
        trainer, normal = {}, {}
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normal = dict(_fields(value))
        if normal.get(2):
            raise ValueError("only normalisers without a character map are compiled")
        self.prefix, self.squeeze = bool(normal.get(3, 1)), bool(normal.get(4, 1))
        self.merging = trainer.get(3, 1) == 2
        self.unknown = self.kinds.index(UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == BYTE}
        usable = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] in (NORMAL, USER)}
        self.vocabulary = usable
        self.split: dict[int, tuple[int, int]] = {}
        if self.merging:
            # a piece that merging never makes of its own string has no arc
            usable = {p: i for p, i in usable.items() if self._build(p, i)}
        self.lexicon = usable
        self.longest = max(map(len, usable), default=1)
        alphabet = {c for p in usable for c in p}
        self.plain = "".join(c for c in "\n\t\r" if c not in alphabet)
        crossing = any(MARK in p.lstrip(MARK) for p in usable)
        # marks of punctuation that no piece has right after a letter end a cut as well
        after = {b for q in usable for a, b in zip(q, q[1:]) if re.match(LETTER, a)}
        marks = "".join(re.escape(c) for c in PUNCTUATION if c not in after)
        ended = f"{MARK}*{LETTER}+(?=[{marks}])|" if marks else ""
        p = re.escape(self.plain)
        self.cut = "(?s).+" if crossing else f"{ended}{MARK}*[^{MARK}{p}]+|{MARK}+" + (f"|[{p}]" if p else "")
        self.least = min(self.scores, default=0.0) - 10.0
        self.pairs: dict[int, bool] = {}

    def _build(self, piece: str, number: int) -> bool:
        """Merges the characters of a piece and keeps the last merge; False if the piece isn't reached."""
        parts = list(piece)
        if len(parts) == 1:
            return True
        while len(parts) > 1:
            best = max(
                ((self.scores[self.vocabulary[a + b]], -i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.vocabulary),
                default=None,
            )
            if best is None:
                return False
            i = -best[1]
            if len(parts) == 2:
                self.split[number] = (self.vocabulary[parts[0]], self.vocabulary[parts[1]])
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return True

    def fits(self, left: int, right: int) -> bool:
        """Whether merging keeps `left` and `right` apart: no merge across their border comes before those inside them."""
        scores, pieces, vocabulary = self.scores, self.pieces, self.vocabulary
        # a merge across the border wins over an inner one of a lower score; on the left side also on a tie with the right's
        limit = (float("-inf"), 0)
        a, b = left, right
        while True:
            joined = vocabulary.get(pieces[a] + pieces[b])
            if joined is not None and (scores[joined], 1) > limit:
                return False
            # undo the later of the two last merges: the lower score; of equal ones the right one
            sa = scores[a] if a in self.split else None
            sb = scores[b] if b in self.split else None
            if sa is None and sb is None:
                return True
            if sb is None or (sa is not None and sa < sb):
                limit, a = (sa, 1), self.split[a][1]
            else:
                limit, b = (sb, 0), self.split[b][0]

    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        return (MARK if self.prefix else "") + text.replace(" ", MARK)

    def path(self, cut: str) -> tuple[int, ...]:
        """Ids on the shortest path through one cut."""
        n, lexicon, longest = len(cut), self.lexicon, self.longest
        last, step = [-1] * (n + 1), [0] * (n + 1)
        if self.merging:
            # every place has one path of cost 0, so its last piece is all there is to know
            pairs = self.pairs
            for end in range(1, n + 1):
                for start in range(end - longest if end > longest else 0, end):
                    piece = lexicon.get(cut[start:end])
                    if piece is None:
                        continue
                    left = last[start]
                    if left < 0:
                        break
                    key = left << 32 | piece
                    fit = pairs.get(key)
                    if fit is None:
                        if len(pairs) >= REMEMBERED:
                            pairs.clear()
                        fit = pairs[key] = self.fits(left, piece)
                    if fit:
                        break
                else:
                    start, piece = end - 1, SPELT
                last[end], step[end] = piece, start
        else:
            far = float("inf")
            cost = [0.0] + [far] * n
            for end in range(1, n + 1):
                for start in range(max(0, end - longest), end):
                    piece = lexicon.get(cut[start:end])
                    if piece is None and start < end - 1:
                        continue
                    total = cost[start] - (self.least if piece is None else self.scores[piece])
                    if total < cost[end]:
                        cost[end], last[end], step[end] = total, SPELT if piece is None else piece, start
        out, end = [], n
        while end:
            start = step[end]
            if last[end] != SPELT:
                out.append((last[end],))
            elif self.bytes:
                out.append(tuple(self.bytes[b] for b in cut[start:end].encode("utf-8", "replace")))
            else:
                out.append((self.unknown,))
            end = start
        return tuple(chain.from_iterable(reversed(out)))

    def text(self, ids) -> str:
        """The text of a sequence of ids."""
        out, raw = [], bytearray()
        for i in ids:
            kind = self.kinds[i]
            if kind == BYTE:
                raw.append(int(self.pieces[i][3:5], 16))
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw = bytearray()
            out.append(" ⁇ " if kind == UNKNOWN else "" if kind == CONTROL else self.pieces[i])
        out.append(raw.decode("utf-8", "replace"))
        text = "".join(out).replace(MARK, " ")
        return text[1:] if self.prefix and text[:1] == " " else text


class Encoder:
    """Encodes and decodes with the paths of recent cuts at hand."""

    def __init__(self, machine: Machine):
        self.machine, self.cut, self.known, self.older = machine, re.compile(machine.cut), {}, {}
        # pieces without state: one look-up each when decoding
        self.simple = [
            p.replace(MARK, " ") if k in (NORMAL, USER) else "" if k == CONTROL
            else chr(int(p[3:5], 16)) if k == BYTE and int(p[3:5], 16) < 128 else None
            for p, k in zip(machine.pieces, machine.kinds)
        ]

    def encode(self, text: str) -> list[int]:
        known, older, path, out = self.known, self.older, self.machine.path, []
        for cut in self.cut.findall(self.machine.normalise(text)):
            ids = known.get(cut)
            if ids is None:
                ids = older.get(cut) or path(cut)
                if len(cut) <= 64:
                    if len(known) >= REMEMBERED:
                        self.older = older = known
                        self.known = known = {}
                    known[cut] = ids
            out += ids
        return out

    def decode(self, ids) -> str:
        try:
            text = "".join([self.simple[i] for i in ids])
        except TypeError:  # bytes among them
            return self.machine.text(ids)
        return text[1:] if self.machine.prefix and text[:1] == " " else text


def _encoder(sent: dict) -> Encoder:
    """One encoder for all tasks of a worker: it stays with the machine's data, which were sent once."""
    if "encoder" not in sent:
        machine = Machine.__new__(Machine)
        machine.__dict__ = {k: v for k, v in sent.items()}
        sent["encoder"] = Encoder(machine)
    return sent["encoder"]


def compiled(path: str = MODEL_PATH) -> Machine:
    """The machine of a model file; read by the driver only."""
    with open(path, "rb") as file:
        return Machine(file.read())


def encode(docs: DataFrame, machine: Machine, text: str = "text") -> DataFrame:
    """`docs` with ids array<int>, n_tokens long and round_trip boolean (decoding gives the normalised text again)."""
    keep = [c for c in docs.columns if c not in ("ids", "n_tokens", "round_trip")]
    docs = docs.select(*keep)
    sent = docs.sparkSession.sparkContext.broadcast(vars(machine))  # as large as the vocabulary

    def run(batches):
        encoder = _encoder(sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                texts = part.column(part.schema.get_field_index(text)).to_pylist()
                ids = [None if t is None else encoder.encode(t) for t in texts]
                same = [None if t is None else encoder.decode(i) == _back(encoder.machine, t) for t, i in zip(texts, ids)]
                count = [None if i is None else len(i) for i in ids]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(ids, pa.list_(pa.int32())), pa.array(count, pa.int64()), pa.array(same, pa.bool_())],
                    names=[*part.schema.names, "ids", "n_tokens", "round_trip"],
                )

    schema = StructType([*docs.schema.fields, *StructType.fromDDL("ids array<int>, n_tokens long, round_trip boolean").fields])
    return docs.mapInArrow(run, schema)


def _back(machine: Machine, text: str) -> str:
    """What decoding should give: the normalised text with its marks as spaces again."""
    if machine.squeeze:
        text = re.sub(" +", " ", text).strip(" ")
    return text.replace(MARK, " ")


def decode(rows: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, text of rows with doc_id, ids; null ids give null."""
    sent = rows.sparkSession.sparkContext.broadcast(vars(machine))

    def work(got: dict) -> dict:
        encoder = _encoder(sent.value)
        return {"doc_id": got["doc_id"], "text": [None if i is None else encoder.decode(i) for i in got["ids"]]}

    return map_rows(rows.select(F.col("doc_id").cast("long").alias("doc_id"), "ids"), work, "doc_id long, text string")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, compiled()).select("doc_id", "n_tokens", "ids", "round_trip")
