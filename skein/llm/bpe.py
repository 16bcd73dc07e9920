"""Byte-level BPE encoding by a traversal of the trie of distinct words, and decoding.

The words that a batch brings and the worker has not met are put in byte order; in that
order their common prefixes are the nodes of a trie and walking the list is a depth-first
traversal. A node's state is the last token of the encoding of the node's prefix. A state
follows from those of the nodes above it: of the tokens that end at the node, exactly one
both leaves a prefix whose own last token it may follow and is no part of a merge across
that border. So a prefix that many words share is encoded once, and a word's ids are read
off by stepping back from its last node, token by token.

Nothing is trained here: vocabulary and merges come from a tokenizer file whose path is a
parameter. Each executor reads the file itself, from the installed package if the path is
None.
"""

from __future__ import annotations

import json
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from skein.llm.textblock import row_blocks

#: Fixed: the split of a text into words that the byte-level tokenizers use, with the white
#: space of the Unicode property written out.
SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
WORD_PATTERN = (
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACES}\p{{L}}\p{{N}}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
)

#: Words that a worker remembers; beyond it the memory starts anew.
MAX_WORDS = 500_000
#: Characters above which a text's words are taken in runs, so that no list holds them all.
LONG_TEXT = 1_000_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies, by character.

    Printable Latin-1 characters stand for themselves; the other bytes, in order, take the
    code points from 256 on.
    """
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """A byte-level BPE vocabulary with encoding and decoding."""

    def __init__(self, path: str) -> None:
        spec = json.load(open(path, encoding="utf-8"))
        alphabet = byte_alphabet()
        raw = lambda token: bytes(alphabet[c] for c in token)
        model = spec["model"]
        size = max([*model["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        ids = {raw(t): i for t, i in model["vocab"].items()}
        for t, i in ids.items():
            self.bytes_of[i] = t
        #: Order in which merges make a token (-1: a byte), and the parts it is made of.
        self.rank = [-1] * size
        self.left, self.right = list(range(size)), list(range(size))
        self.merge: dict[int, int] = {}
        for k, pair in enumerate(model["merges"]):
            a, b = (raw(x) for x in (pair if isinstance(pair, list) else pair.split(" ")))
            i, j, made = ids[a], ids[b], ids[a + b]
            self.merge.setdefault(i << 20 | j, k)
            if self.rank[made] < 0:
                self.rank[made], self.left[made], self.right[made] = k, i, j
        #: The tokens, read backwards, as a trie: (node << 8 | byte) -> node, and a node's token.
        self.back: dict[int, int] = {}
        self.token_at = [-1]
        for t, i in ids.items():
            node = 0
            for b in reversed(t):
                key = node << 8 | b
                node = self.back.get(key, 0)
                if not node:
                    node = self.back[key] = len(self.token_at)
                    self.token_at.append(-1)
            self.token_at[node] = i
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.special.items():
            self.bytes_of[i] = content.encode()
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.words = regex.compile(WORD_PATTERN)
        self.apart: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}

    def stays_apart(self, a: int, b: int) -> bool:
        """Whether b may follow a: no merge takes place across the border between them.

        Going back in time, the later made of the two border pieces is undone; at each step
        the two pieces side by side would have merged if their merge came before that.
        """
        key = a << 20 | b
        if (found := self.apart.get(key)) is not None:
            return found
        rank, limit, good = self.rank, len(self.rank) + 1, True
        while True:
            k = self.merge.get(a << 20 | b)
            if k is not None and k < limit:
                good = False
                break
            if rank[a] > rank[b]:
                limit, a = rank[a], self.right[a]
            elif rank[b] >= 0:
                # An equal merge further left goes first.
                limit, b = rank[b] + 1, self.left[b]
            else:
                break
        if len(self.apart) > 2_000_000:
            self.apart.clear()
        self.apart[key] = good
        return good

    def learn(self, fresh: set[str]) -> None:
        """Encode words and remember their ids as packed little-endian 32-bit numbers."""
        back, token_at, bytes_of, apart, stays = self.back, self.token_at, self.bytes_of, self.apart, self.stays_apart
        state: list[int] = [-1]
        before = b""
        for raw, word in sorted((w.encode(), w) for w in fresh):
            shared, top = 0, min(len(raw), len(before))
            while shared < top and raw[shared] == before[shared]:
                shared += 1
            del state[shared + 1 :]
            for end in range(shared, len(raw)):
                node, at, ends = 0, end, []
                while at >= 0:
                    node = back.get(node << 8 | raw[at], 0)
                    if not node:
                        break
                    if token_at[node] >= 0:
                        ends.append((token_at[node], at))
                    at -= 1
                for token, at in reversed(ends):
                    last = state[at]
                    if last < 0:
                        break
                    ok = apart.get(last << 20 | token)
                    if ok or ok is None and stays(last, token):
                        break
                state.append(token)
            before = raw
            out, end = [], len(raw)
            while end:
                out.append(state[end])
                end -= len(bytes_of[state[end]])
            self.known[word] = b"".join(t.to_bytes(4, "little") for t in reversed(out))

    def _lookup(self, runs: list[list[str]]) -> None:
        """Make every word of the runs known, new ones by one walk of their trie."""
        met = set().union(*runs)
        fresh = met.difference(self.known)
        if len(self.known) + len(fresh) > MAX_WORDS:
            self.known.clear()
            fresh = met
        if fresh:
            self.learn(fresh)

    def _piece(self, text: str) -> bytes:
        if len(text) <= LONG_TEXT:
            runs = iter([self.words.findall(text)])
        else:
            found = (m.group() for m in self.words.finditer(text))
            runs = iter(lambda: list(islice(found, 100_000)), [])
        out = []
        for run in runs:
            self._lookup([run])
            out.append(b"".join(map(self.known.__getitem__, run)))
        return b"".join(out)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """encode() of each text, with one trie for the new words of all plain ones."""
        plain = [k for k, t in enumerate(texts) if len(t) <= LONG_TEXT and not (self.cut and self.cut.search(t))]
        runs = [self.words.findall(texts[k]) for k in plain]
        self._lookup(runs)
        out: list[bytes] = [b""] * len(texts)
        for k, run in zip(plain, runs):
            out[k] = b"".join(map(self.known.__getitem__, run))
        for k in set(range(len(texts))).difference(plain):
            out[k] = self.encode(texts[k])
        return out

    def encode(self, text: str) -> bytes:
        """Ids of the text, packed as little-endian unsigned 32-bit integers."""
        if self.cut is None or not self.cut.search(text):
            return self._piece(text)
        return b"".join(self.special[p].to_bytes(4, "little") if p in self.special else self._piece(p) for p in self.cut.split(text) if p)

    def decode(self, packed: bytes) -> str:
        """Text of packed ids; what is not UTF-8 becomes U+FFFD."""
        ids = memoryview(packed).cast("I").tolist()
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_LOADED: dict[str, Bpe] = {}


def tokenizer(path: str | None) -> Bpe:
    """The tokenizer of a file, loaded once per worker; None: the 50k byte-level vocabulary."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def encode_and_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded) of each row of docs (columns doc_id, text; null text: empty).

    ids is binary, the token ids as little-endian unsigned 32-bit integers, empty for an
    empty text; decoded is the text that the ids decode to. Rows are independent: there is no
    exchange, repeated rows give repeated results, and an empty table gives an empty table.
    """

    def run(batches):
        bpe = tokenizer(path)
        for batch in batches:
            for part in row_blocks(batch, 1):
                ids = bpe.encode_all([text.as_py() or "" for text in part.column(1)])
                decoded = [bpe.decode(packed) for packed in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids binary, decoded string")
