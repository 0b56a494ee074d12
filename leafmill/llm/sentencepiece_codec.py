"""SentencePiece BPE encoding by backtracking over longest matches, and decoding.

An encoding of merge type is the one sequence of pieces in which every two neighbours stay as they are when their
joined text is merged again. So a text is read left to right: an Aho-Corasick automaton gives the pieces that begin at
a position, the longest is taken first, and it stays only if it is compatible with the piece before it; if none is, the
search steps back and takes the next shorter piece there. Positions from which no way led on are marked in a bitfield
and never tried again, so the whole takes linear time. Compatible means: merging the two texts together, highest score
and leftmost first, gives these two pieces.

Texts fall apart at characters that no piece joins: before a run of spaces, and around characters without a piece,
which are written as bytes. Parts repeat, so each worker keeps the parts that it has encoded.
"""

import codecs
import hashlib
import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship_code
from .shared import text_or_empty

SPACE = "▁"
#: A worker keeps the parts of late, between one and two times so many: some 60 MB. It only saves time.
KEPT_PARTS = 150_000
#: Pairs of pieces whose compatibility a worker remembers: some 70 MB.
KEPT_PAIRS = 600_000


def _each_byte(e: UnicodeError) -> tuple[str, int]:
    return "�" * (e.end - e.start), e.end


codecs.register_error("leafmill-each-byte", _each_byte)


def read_model(path: str) -> dict:
    """Pieces, scores and settings of a BPE model file with byte fallback."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    rules = model.normalizer_spec
    if model.trainer_spec.model_type != proto.TrainerSpec.BPE or rules.precompiled_charsmap or rules.remove_extra_whitespaces:
        raise ValueError("only BPE models that leave texts as they are can be used")
    kind = proto.ModelProto.SentencePiece
    unusual = {kind.USER_DEFINED, kind.UNUSED} & {p.type for p in model.pieces}
    if unusual or not model.trainer_spec.byte_fallback:
        raise ValueError("models with user-defined or unused pieces, or without byte fallback, can't be used")
    return {
        "key": hashlib.sha256(model.SerializeToString(deterministic=True)).hexdigest(),
        "pieces": [p.piece for p in model.pieces],
        "scores": [p.score for p in model.pieces],
        "normal": [p.type == kind.NORMAL for p in model.pieces],
        "byte": [p.type == kind.BYTE for p in model.pieces],
        "control": [p.type == kind.CONTROL for p in model.pieces],
        "end_id": next(i for i, p in enumerate(model.pieces) if p.piece == (model.trainer_spec.eos_piece or "</s>")),
        "dummy_prefix": rules.add_dummy_prefix,
    }


class Codec:
    def __init__(self, model: dict):
        self.end_id = model["end_id"]
        self.prefix = SPACE if model["dummy_prefix"] else ""
        self.ids = {p: i for i, (p, ok) in enumerate(zip(model["pieces"], model["normal"], strict=True)) if ok}
        self.scores = model["scores"]
        self.byte_ids = [0] * 256
        self.raw: list[bytes] = []
        for i, piece in enumerate(model["pieces"]):
            if model["byte"][i]:
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.raw.append(bytes([value]))
            elif model["normal"][i]:
                self.raw.append(piece.replace(SPACE, " ").encode())
            else:
                self.raw.append(b"" if model["control"][i] else " ⁇ ".encode())
        known = {c for p in self.ids for c in p}
        inner = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        if inner:
            raise ValueError("a piece joins two words")
        self.known = known
        self.pairs: dict[int, bool] = {}
        self.machine = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            if self.merge(piece) == [i]:  # a piece that its own merges don't reach never stands in an encoding
                self.machine.add_word(piece, (i, len(piece)))
        self.machine.make_automaton()
        self.said = [str(i) for i in range(len(self.raw))]
        self.end = array("i", [self.end_id]).tobytes()
        # a part and its ids, packed: several times smaller than as numbers
        self.parts: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.split = re.compile("\n| *[^ \n]+| +").findall

    def merge(self, text: str) -> list[int]:
        """The encoding of a text of known characters by its merges: highest score first, leftmost of equals."""
        parts: list[str | None] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        ids, scores = self.ids, self.scores

        def pair(i: int) -> tuple[float, int, int, str] | None:
            j = after[i]
            if j < len(parts) and (k := ids.get(joined := parts[i] + parts[j])) is not None:
                return -scores[k], i, j, joined
            return None

        heap = [x for i in range(len(parts) - 1) if (x := pair(i))]
        heapify(heap)
        while heap:
            _, i, j, joined = heappop(heap)
            if parts[i] is None or after[i] != j or parts[j] is None or parts[i] + parts[j] != joined:
                continue
            parts[i], parts[j] = joined, None
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            if before[i] >= 0 and (x := pair(before[i])):
                heappush(heap, x)
            if x := pair(i):
                heappush(heap, x)
        return [i for p in parts if p is not None for i in ([ids[p]] if p in ids else self.as_bytes(p))]

    def as_bytes(self, text: str) -> list[int]:
        return [self.byte_ids[b] for b in text.encode()]

    def compatible(self, a: int, b: int, joined: str) -> bool:
        """Whether merging the joined text of pieces a and b gives these two."""
        if len(self.pairs) > KEPT_PAIRS:
            self.pairs.clear()
        found = self.pairs[a << 32 | b] = self.merge(joined) == [a, b]
        return found

    def search(self, text: str) -> list[int]:
        """The encoding of a text of known characters by backtracking."""
        size = len(text)
        starts: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]
        for end, (i, n) in self.machine.iter(text):
            starts[end - n + 1].append((n, i))  # the longest comes last
        failed = bytearray(size // 8 + 1)
        path: list[tuple[int, int, int]] = []  # position, id, shorter pieces that are left there
        known = self.pairs.get
        at, last, start, left = 0, -1, 0, len(starts[0])
        while at < size:
            options = starts[at]
            while left:
                left -= 1
                n, i = options[left]
                to = at + n
                if failed[to >> 3] >> (to & 7) & 1:
                    continue
                if last >= 0:
                    fits = known(last << 32 | i)
                    if fits is None:
                        fits = self.compatible(last, i, text[start:to])
                    if not fits:
                        continue
                path.append((at, i, left))
                start, at, last, left = at, to, i, len(starts[to])
                break
            else:
                failed[at >> 3] |= 1 << (at & 7)
                at, _, left = path.pop()
                start, last = (path[-1][0], path[-1][1]) if path else (0, -1)
        return [i for _, i, _ in path]

    def encode_part(self, part: str) -> list[int]:
        out: list[int] = []
        for is_known, piece in self.runs(part):
            if not is_known:
                out += self.as_bytes(piece)
            else:
                out += self.search(piece)
        return out

    def runs(self, part: str) -> list[tuple[bool, str]]:
        """The part, cut at characters that have no piece."""
        known = self.known
        if known.issuperset(part):
            return [(True, part)] if part else []
        found: list[tuple[bool, str]] = []
        start = 0
        for i in range(1, len(part) + 1):
            if i == len(part) or (part[i] in known) != (part[start] in known):
                found.append((part[start] in known, part[start:i]))
                start = i
        return found

    def encode(self, text: str) -> list[int]:
        """The ids of a text, without an end id; an empty text has none."""
        return unpacked(self.encoded(text)).tolist()

    def encoded(self, text: str) -> list[bytes]:
        """The ids part by part, packed."""
        if not text:
            return []
        # spaces stand for the space mark up to here, which keeps most strings at a byte a character
        if SPACE in text:
            text = text.replace(SPACE, " ")
        kept, out = self.parts, []
        for part in self.split(" " + text if self.prefix else text):
            found = kept.get(part)
            if found is None:
                found = self.older.get(part)
                if found is None:
                    found = array("i", self.encode_part(part.replace(" ", SPACE))).tobytes()
                if len(part) <= 64:
                    if len(kept) >= KEPT_PARTS:
                        self.older, self.parts = kept, {}
                        kept = self.parts
                    kept[part] = found
            out.append(found)
        return out

    def decode(self, ids) -> str:
        """The text of ids: pieces joined, bytes put together, the added leading space gone."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "leafmill-each-byte")
        return text[1:] if self.prefix and text.startswith(" ") else text


def unpacked(parts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(parts), dtype=np.int32)


_made: dict[str, Codec] = {}


def codec_of(model: dict) -> Codec:
    """The model's codec, made once in a worker and used by its next tasks too, with the parts that it has kept."""
    if model["key"] not in _made:
        _made.clear()
        _made[model["key"]] = Codec(model)
    return _made[model["key"]]


def round_trip(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256, n_chars_decoded.

    Null texts count as empty: their one id is the end id. Ids may be null or repeat. No row, no result. Other columns
    of docs are not looked at. model: what read_model() gives, half a megabyte whatever the data.
    """
    ship_code(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_chars_decoded long"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model)
        said, sha = codec.said.__getitem__, hashlib.sha256
        for batch in batches:
            rows = []
            for text in batch.column(1):
                ids = unpacked([*codec.encoded(text.as_py()), codec.end]).tolist()
                decoded = codec.decode(ids)
                rows.append((len(ids), sha(" ".join(map(said, ids)).encode()).hexdigest(), sha(decoded.encode()).hexdigest(), len(decoded)))
            columns = [pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], type=t) for t in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_chars_decoded"]
    return docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(work, schema)


def _ids(codec: Codec, texts: pa.Array) -> pa.ListArray:
    """The ids of each text, the end id included."""
    flat, bounds = bytearray(), array("i", [0])
    for text in texts:
        flat += b"".join(codec.encoded(text.as_py()))
        flat += codec.end
        bounds.append(len(flat) // 4)
    return pa.ListArray.from_arrays(pa.array(np.frombuffer(bounds, dtype=np.int32)), pa.array(np.frombuffer(flat, dtype=np.int32)))


def _texts(codec: Codec, ids: pa.ListArray) -> pa.Array:
    """The text that each row's ids decode to."""
    return pa.array([codec.decode(row.values.to_pylist() if row.is_valid else ()) for row in ids], type=pa.string())


def encode_documents(docs: DataFrame, model: dict, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with `ids_col`: the ids of each text with the end id. Null texts count as empty: their one id is the end id.
    A column of that name is replaced, all others stay; rows may repeat. No row, no result."""

    def work(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = codec_of(model)
        for texts in batches:
            yield _ids(codec, texts)

    ship_code(docs.sparkSession)
    return docs.withColumn(ids_col, F.arrow_udf(work, "array<int>")(text_or_empty(text_col)))


def decode_documents(docs: DataFrame, model: dict, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """docs with `text_col`: the text that each row's ids decode to. Null or no ids give an empty text. A column of that
    name is replaced, all others stay; rows may repeat. No row, no result."""

    def work(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = codec_of(model)
        for ids in batches:
            yield _texts(codec, ids)

    ship_code(docs.sparkSession)
    return docs.withColumn(text_col, F.arrow_udf(work, "string")(F.col(ids_col)))


def code_documents(docs: DataFrame, model: dict, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """docs with `ids_col` and `decoded_col`: what encode_documents() and then decode_documents() give, from one pass in
    one worker a task, where these two would hold a worker and a codec each. Null texts count as empty, columns of these
    names are replaced, all others stay; rows may repeat. No row, no result."""

    def work(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = codec_of(model)
        for texts in batches:
            ids = _ids(codec, texts)
            yield pa.StructArray.from_arrays([ids, _texts(codec, ids)], names=["ids", "decoded"])

    ship_code(docs.sparkSession)
    # both results in one column, of a name that docs hasn't
    both = "coded"
    while both in map(str.lower, docs.columns):
        both += "_"
    coded = docs.withColumn(both, F.arrow_udf(work, "struct<ids: array<int>, decoded: string>")(text_or_empty(text_col)))
    return coded.withColumns({ids_col: F.col(f"{both}.ids"), decoded_col: F.col(f"{both}.decoded")}).drop(both)


def default_model() -> dict:
    import public_tokenizers

    return read_model(public_tokenizers.path("piece_bpe_32k.model"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_model()).drop("n_chars_decoded")
