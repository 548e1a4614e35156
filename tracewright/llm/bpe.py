"""Byte-pair encoding of whole texts under a public vocabulary, and its decoding.

Texts are cut just before white space, where neither normalisation nor any token can reach across, into pieces
of at most ``piece`` characters. Pieces of long texts are dealt over the cluster and their ids put together by
document. A stretch without white space may be longer than a piece; it is normalised and split as the vocabulary
says, and a word that is still too long is encoded by tree concatenation: its halves, their halves and so on
down to leaves of ``leaf`` symbols are encoded in parallel; then neighbours are joined pairwise. At a join, a
window of the last tokens of the left part and the first of the right one is encoded anew and grows until its
outermost tokens are those that the parts had there. Then every two neighbouring tokens are ones that the
merges leave apart, which makes the whole sequence the encoding of the whole word.

Cut at white space, a text is the words between. A task keeps the ids of the words it has met, up to a bound, and only
new ones are encoded. Texts of plain Latin letters, digits and ASCII signs, about which all versions of Unicode agree,
are cut into words by the vocabulary's own pattern; any other text is left to the library between its white space.

Ids are kept as bytes, unsigned 32-bit little-endian. Vocabularies are files of the ``tokenizers`` library,
of a megabyte or two, read on the driver and sent to the executors.

Cases. Null and empty texts have no ids and decode to the empty text. Strings of special tokens in a text are
special tokens, as the library has it. Rows with the same doc_id are each encoded; a null doc_id stays null.
An empty table gives an empty result. Other columns are never read.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import shipped, small_batches, written

PIECE, LEAF = 1 << 16, 1 << 12
KNOWN = 1 << 18  # words whose ids a task keeps
LATIN = "À-ÖØ-Þß-öø-ÿ"  # the letters of Latin-1, upper case first
#: How byte-level vocabularies write bytes: those that print as they are, the others as characters from 256 on.
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
SYMBOLS = {b: b if b in PRINTED else 256 + i for i, b in enumerate(sorted(range(256), key=lambda b: (b in PRINTED, b)))}
#: What a piece is: text as it stands; words of symbols, parted by spaces; a leaf inside a word; a word's last leaf.
TEXT, WORDS, LEAF_IN, LEAF_END = range(4)
ENCODED = "doc_id long, n_tokens long, ids binary"


class Coder:
    """A vocabulary as the library reads it, and its bare merges for symbols that are normalised and split already."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.file = file
        self.whole = Tokenizer.from_str(file)
        self.whole.no_padding()
        self.whole.no_truncation()
        spec = json.loads(file)
        self.end = spec["model"].get("end_of_word_suffix") or ""
        special = sorted((t.content for t in self.whole.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.known: dict[str, bytes] = {}
        self.plain = plain_words(spec)
        self.odd = re.compile("|".join([rf"[^\t\n\r -~{LATIN}]", *map(re.escape, special)]))
        ids = lambda text: self.whole.encode(text, add_special_tokens=False).ids
        if ids(" a  b\n\tc ") != ids("a") + ids("b") + ids("c"):
            raise ValueError("the vocabulary must drop white space")

    def bare(self, end: str | None):
        """The merges alone, for symbols parted by spaces."""
        from tokenizers import Tokenizer, pre_tokenizers

        spec = json.loads(self.file)
        spec |= dict.fromkeys(("normalizer", "pre_tokenizer", "post_processor", "padding", "truncation")) | {"added_tokens": []}
        out = Tokenizer.from_str(json.dumps(spec | {"model": spec["model"] | {"end_of_word_suffix": end}}))
        out.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
        return out

    # Made when first used: a task that decodes needs neither, few need the second.
    @cached_property
    def words(self):
        return self.bare(self.end or None)

    @cached_property
    def inside(self):
        return self.bare(None)

    def texts(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts or pieces of them, as bytes."""
        split, met, odd = [], set(), set()
        for text in texts:
            easy = self.plain and not self.odd.search(text)
            split.append(self.plain.findall(text.lower()) if easy else WORD.findall(text))
            (met if easy else odd).update(split[-1])
        if len(self.known) + len(met) + len(odd) > KNOWN:
            self.known.clear()
        tokenize = self.words.model.tokenize
        for word in met - odd:
            if word not in self.known:
                symbols = word if word.isascii() else word.encode().decode("latin-1").translate(SYMBOLS)
                self.known[word] = packed([t.id for t in tokenize(symbols)])
        new = [w for w in odd if w not in self.known]
        self.known.update(zip(new, (packed(e.ids) for e in self.whole.encode_batch_fast(new, add_special_tokens=False))))
        return [b"".join(map(self.known.__getitem__, words)) for words in split]

    def pieces(self, kinds: list[int], texts: list[str]) -> list[bytes]:
        out = [b""] * len(texts)
        for kind, by in ((TEXT, None), (WORDS, self.words), (LEAF_IN, self.inside), (LEAF_END, self.words)):
            if at := [i for i, k in enumerate(kinds) if k == kind]:
                some = [texts[i] for i in at]
                found = self.texts(some) if by is None else [packed(e.ids) for e in by.encode_batch_fast(some, add_special_tokens=False)]
                for i, ids in zip(at, found):
                    out[i] = ids
        return out

    def symbols(self, ids: list[int]) -> str:
        return "".join(map(self.words.id_to_token, ids))

    def part(self, symbols: str, last: bool) -> list[int]:
        """Ids of a part of a word; the last one may end in the mark of a word's end."""
        if last:
            return self.words.encode(symbols.removesuffix(self.end), add_special_tokens=False).ids
        return self.inside.encode(symbols, add_special_tokens=False).ids

    def joined(self, left: list[int], right: list[int], last: bool, at: int = 4) -> list[int]:
        """Ids of two neighbouring parts of a word, as if they had been encoded as one."""
        while True:
            i, j = max(len(left) - at, 0), min(at, len(right))
            window = self.part(self.symbols(left[i:] + right[:j]), last and j == len(right))
            if (i == 0 or window[0] == left[i]) and (j == len(right) or window[-1] == right[j - 1]):
                return left[:i] + window + right[j:]
            at *= 2

    def tree(self, leaves: list[list[int]]) -> list[int]:
        """Ids of a whole word from those of its leaves; the last leaf ends the word."""
        while len(leaves) > 1:
            pairs = [leaves[i : i + 2] for i in range(0, len(leaves), 2)]
            leaves = [self.joined(*p, last=i == len(pairs) - 1) if len(p) == 2 else p[0] for i, p in enumerate(pairs)]
        return leaves[0] if leaves else []

    def cut(self, text: str, piece: int, leaf: int) -> Iterator[tuple[int, str]]:
        """Pieces of a text in order, whose encodings make up that of the text."""
        at = 0
        while at < len(text):
            end = at + piece
            if end >= len(text):
                yield TEXT, text[at:]
                return
            cut = max(text.rfind(" ", at + 1, end + 1), text.rfind("\n", at + 1, end + 1))
            if cut > 0:
                yield TEXT, text[at:cut]
                at = cut
                continue
            follow = SPACE.search(text, end)
            cut = follow.start() if follow else len(text)
            yield from self.unsplit(text[at:cut], piece, leaf)
            at = cut

    def unsplit(self, stretch: str, piece: int, leaf: int) -> Iterator[tuple[int, str]]:
        for i, part in enumerate(self.special.split(stretch) if self.special else [stretch]):
            if i % 2:
                yield TEXT, part
                continue
            if self.whole.normalizer:
                part = self.whole.normalizer.normalize_str(part)
            words, size = [], 0
            for word, _ in self.whole.pre_tokenizer.pre_tokenize_str(part) if part else []:
                if size + len(word) > piece and words:
                    yield WORDS, " ".join(words)
                    words, size = [], 0
                if len(word) <= piece:
                    words.append(word)
                    size += len(word)
                    continue
                ends = range(leaf, len(word), leaf)
                for end in ends:
                    yield LEAF_IN, word[end - leaf : end]
                yield LEAF_END, word[len(ends) * leaf :]
            if words:
                yield WORDS, " ".join(words)


def plain_words(spec: dict) -> re.Pattern | None:
    """What cuts lower-cased plain text into words as the vocabulary does; none if it doesn't cut by one pattern."""
    parts = lambda x, name: x.get(name, [x]) if x else []
    norms = {(x["type"], str(x.get("pattern", "")), x.get("content", "")) for x in parts(spec["normalizer"], "normalizers")}
    cut = parts(spec["pre_tokenizer"], "pretokenizers")
    shape = [(x["type"], x.get("behavior"), x.get("invert"), x.get("add_prefix_space"), x.get("use_regex")) for x in cut]
    if norms != {("NFC", "", ""), ("Replace", str({"Regex": r"\s+"}), " "), ("Lowercase", "", "")} or shape != [("Split", "Removed", True, None, None), ("ByteLevel", None, None, False, False)]:
        return None
    pattern = cut[0]["pattern"].get("Regex", "")
    plain = pattern.replace(r"\p{L}", f"a-z{LATIN[6:]}").replace(r"\p{N}", "0-9").replace(r"\s", r" \t\n\r")
    return None if "\\p" in plain else re.compile(plain)


SPACE, WORD = re.compile("[ \n]"), re.compile("[^ \t\n\r]+")


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def coder(docs: DataFrame, path: str) -> Callable[[], Coder]:
    with open(path, encoding="utf-8") as file:
        return shipped(docs.sparkSession, file.read(), ready)


def ready(file: str) -> Coder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return Coder(file)


def encode(docs: DataFrame, path: str, piece: int = PIECE, leaf: int = LEAF) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids under the vocabulary in the driver's file ``path``."""
    get = coder(docs, path)
    rows = small_batches(docs).select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    long = F.char_length("text") > piece

    def whole(batches):
        for batch in batches:
            found = get().texts(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) // 4 for x in found], pa.int64()), pa.array(found, pa.binary())], ["doc_id", "n_tokens", "ids"])

    def cut(batches):
        for batch in batches:
            for row, doc_id, text in zip(*(batch.column(x).to_pylist() for x in ("row", "doc_id", "text"))):
                for at, (kind, part) in enumerate(get().cut(text, piece, leaf)):
                    yield pa.RecordBatch.from_pydict({"row": [row], "doc_id": [doc_id], "at": [at], "kind": [kind], "part": [part]}, cut_schema)

    def by_piece(batches):
        for batch in batches:
            found = get().pieces(batch.column("kind").to_pylist(), batch.column("part").to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("row", "doc_id", "at", "kind")), pa.array(found, pa.binary())], ["row", "doc_id", "at", "kind", "ids"])

    def join(group):
        """The pieces of one text."""
        group, out, leaves = group.sort_by("at"), [], []
        for kind, ids in zip(group.column("kind").to_pylist(), group.column("ids").to_pylist()):
            if kind < LEAF_IN:
                out.append(ids)
                continue
            leaves.append(np.frombuffer(ids, "<u4").tolist())
            if kind == LEAF_END:
                out.append(packed(get().tree(leaves)))
                leaves = []
        ids = b"".join(out)
        return pa.table({"doc_id": group.column("doc_id")[:1], "n_tokens": pa.array([len(ids) // 4], pa.int64()), "ids": pa.array([ids], pa.binary())})

    cut_schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("kind", pa.int32()), ("part", pa.string())])
    cuts = rows.where(long).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(cut, "row long, doc_id long, at long, kind int, part string")
    pieces = written(cuts.repartition("row", "at"), "pieces").mapInArrow(by_piece, "row long, doc_id long, at long, kind int, ids binary")
    return rows.where(~long).mapInArrow(whole, ENCODED).unionByName(pieces.groupBy("row").applyInArrow(join, ENCODED))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with the text that its ids stand for, special tokens included."""
    get = coder(encoded, path)

    def texts(batches):
        for batch in batches:
            ids = [np.frombuffer(x, "<u4").tolist() for x in batch.column("ids").to_pylist()]
            yield batch.append_column("text", pa.array(get().whole.decode_batch(ids, skip_special_tokens=False), pa.string()))

    return small_batches(encoded).select("doc_id", "n_tokens", "ids").mapInArrow(texts, f"{ENCODED}, text string")
