"""BPE encoding and decoding (3): one last token per prefix, found left to right, then back-pointers.

For every prefix of a word the merges leave exactly one last token. Candidates are the vocabulary's tokens
that end there, found by a suffix automaton (Aho-Corasick); the right one is the candidate that stays
unmerged beside the last token of the prefix before it. Time is linear in the word's length, also for a
word of a million letters, and the ids are those of merging by rank.

The text is normalised and split as the vocabulary file says: NFC, lower case letter by letter, blanks
dropped, words, single digits and runs of other marks as pieces; the file's special strings are ids of
their own. Null and empty texts give no id and decode to the empty text. Decoding joins the tokens with
one blank, as the file names no decoder. Repeated rows give equal results; other columns are ignored.
"""

import functools
import hashlib
import json
import unicodedata
from array import array

import numpy as np
import pyarrow as pa

from newsloom.llm.common import ship, table

#: Words and pieces whose ids a worker remembers, in two generations of this size.
CACHE_WORDS = 250_000
END = "</w>"


def byte_letters():
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


class Recent:
    """A bounded map: when the younger half is full, the older half is forgotten."""

    def __init__(self, size):
        self.size, self.young, self.old = size, {}, {}

    def get(self, key):
        found = self.young.get(key)
        if found is None:
            found = self.old.get(key)
            if found is not None:
                self.put(key, found)
        return found

    def put(self, key, value):
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        self.young[key] = value


class Bpe:
    """Encoder and decoder for one vocabulary file.

    Inside, a symbol is the byte's code point; a byte that ends a piece is another symbol, 256 higher.
    """

    def __init__(self, path, cache_words=CACHE_WORDS):
        import ahocorasick
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for text, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = text
        self.byte = {letter: chr(b) for b, letter in byte_letters().items()}
        self.rank, self.parts, self.made = {}, {}, {}
        for r, (a, b) in enumerate(spec["model"]["merges"]):
            a, b = vocab[a], vocab[b]
            joined = vocab[self.tokens[a] + self.tokens[b]]
            self.made[a, b] = joined
            self.parts[joined] = (a, b)
            self.rank[joined] = r
        self.matches, self.sizes = ahocorasick.Automaton(), [0] * len(self.tokens)
        for text, i in vocab.items():
            body = "".join(map(self.byte.__getitem__, text.removesuffix(END)))
            if text.endswith(END):
                body = body[:-1] + chr(ord(body[-1]) + 256)
            self.sizes[i] = len(body)
            self.matches.add_word(body, i)
        self.matches.make_automaton()
        library = Tokenizer.from_file(path)  # its text rules only, for letters outside the Latin blocks
        self.normalise, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.latin = regex.compile(r"[\x00-\u024F]*").fullmatch
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\x09-\x0D\x20\x85\xA0\p{L}\p{N}]+").findall
        self.marks = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.words, self.known, self.pairs, self.size = Recent(cache_words), Recent(cache_words), {}, cache_words

    def stays_apart(self, left, right):
        """True if merging by rank never joins anything across the border of the tokens ``left`` and ``right``."""
        # Undo the merges inside both tokens, latest first. At every moment the two symbols at the border must
        # not have a merge that would have come before the merge undone just now.
        made, parts, rank = self.made, self.parts, self.rank
        limit, strict = len(rank), False
        while True:
            joined = made.get((left, right))
            if joined is not None and (rank[joined] < limit or rank[joined] == limit and not strict):
                return False
            a, b = rank.get(left, -1), rank.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:  # the left token was finished last; equal ranks are merged from the left
                limit, strict = a, True
                left = parts[left][1]
            else:
                limit, strict = b, False
                right = parts[right][0]

    def piece(self, symbols):
        """Ids of one piece, by the table of last tokens."""
        n = len(symbols)
        symbols = symbols[:-1] + chr(ord(symbols[-1]) + 256)
        last, sizes, pairs = [-1] * (n + 1), self.sizes, self.pairs
        for end, i in self.matches.iter(symbols):
            end += 1
            if last[end] >= 0:
                continue
            begin = end - sizes[i]
            if begin:
                key = last[begin] << 24 | i
                fits = pairs.get(key)
                if fits is None:
                    if len(pairs) > 2 * self.size:
                        pairs.clear()
                    fits = pairs[key] = self.stays_apart(last[begin], i)
                if not fits:
                    continue
            last[end] = i
        ids = []
        while n:
            ids.append(last[n])
            n -= sizes[last[n]]
        return array("I", ids[::-1]).tobytes()

    def plain(self, text):
        """Packed ids of a text without special strings."""
        if self.latin(text):
            text = unicodedata.normalize("NFC", text)
        if self.latin(text):
            parts = [p.encode().decode("latin-1") for p in self.pieces(text.lower())]
        else:
            parts = ["".join(map(self.byte.__getitem__, p)) for p, _ in self.split(self.normalise(text))]
        out, known = [], self.known
        for part in parts:
            ids = known.get(part)
            if ids is None:
                ids = self.piece(part)
                if len(part) <= 256:
                    known.put(part, ids)
            out.append(ids)
        return b"".join(out)

    def word(self, raw):
        """Packed ids of a run of non-blank bytes."""
        text = raw.decode()
        if not self.marks or "<|" not in text:
            return self.plain(text)
        return b"".join(array("I", [self.special[part]]).tobytes() if k % 2 else self.plain(part)
                        for k, part in enumerate(self.marks.split(text)))

    def encode(self, text):
        """Ids of a whole text as an array. Pieces never span ASCII blanks, so words are looked up one by one."""
        words, out = self.words, []
        for raw in text.encode().split():
            ids = words.young.get(raw)
            if ids is None:
                ids = words.get(raw)
                if ids is None:
                    ids = self.word(raw)
                    if len(raw) <= 256:
                        words.put(raw, ids)
            out.append(ids)
        return array("I", b"".join(out))

    def decode(self, ids):
        return " ".join(map(self.tokens.__getitem__, ids))


@functools.lru_cache(maxsize=1)
def coder(path):
    """The worker's encoder; what it remembers serves later tasks too."""
    return Bpe(path)


def encode_batches(path):
    """mapInArrow function: (doc_id, text) -> doc_id, ids, decoded text."""
    def run(batches):
        bpe = coder(path)
        for batch in batches:
            for part in (batch.slice(k, 64) for k in range(0, batch.num_rows, 64)):  # a few texts at a time in memory
                ids = [bpe.encode(t or "") for t in part.column("text").to_pylist()]
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                flat = np.concatenate([np.frombuffer(x, np.uint32) for x in ids]).astype(np.int32)
                yield pa.record_batch([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                                      names=["doc_id", "ids"])
    return run


def encode_table(docs, path):
    """doc_id and the ids of every text."""
    return docs.select("doc_id", "text").mapInArrow(encode_batches(path), "doc_id long, ids array<int>")


def coded_batches(path):
    """mapInArrow function: (doc_id, text) -> doc_id, n_tokens, ids and the digest of their decoding."""
    def run(batches):
        bpe = coder(path)
        for batch in encode_batches(path)(batches):
            ids = batch.column("ids")
            flat, ends = ids.flatten().to_numpy(), ids.offsets.to_numpy()
            seen = [hashlib.sha256(bpe.decode(flat[a:b].tolist()).encode()).hexdigest() for a, b in zip(ends, ends[1:])]
            yield pa.record_batch([batch.column("doc_id"), pa.array(np.diff(ends).astype(np.int64)), ids, pa.array(seen)],
                                  names=["doc_id", "n_tokens", "ids", "decoded_sha256"])
    return run


def coded_table(docs, path):
    """doc_id, n_tokens, ids and decoded_sha256 of every text, repeated rows kept."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(
        coded_batches(path), "doc_id long, n_tokens long, ids array<int>, decoded_sha256 string")


def digest_batches(path):
    """mapInArrow function: the digests of ids and of their decoding."""
    def run(batches):
        bpe = coder(path)
        for batch in batches:
            for part in (batch.slice(k, 64) for k in range(0, batch.num_rows, 64)):
                rows = []
                for text in part.column("text").to_pylist():
                    ids = bpe.encode(text or "")
                    rows.append((len(ids), hashlib.sha256(np.frombuffer(ids, np.uint32).astype("<u4").tobytes()).hexdigest(),
                                 hashlib.sha256(bpe.decode(ids).encode()).hexdigest()))
                n, a, b = zip(*rows)
                yield pa.record_batch([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(a), pa.array(b)],
                                      names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return run


def vocabulary():
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def op3_bpe(spark, folder):
    ship(spark)
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return docs.mapInArrow(digest_batches(vocabulary()),
                           "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
