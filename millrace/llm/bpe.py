"""Byte-level BPE: a lazily determinised transducer encodes, a UTF-8 state machine decodes."""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, chunks, paused_collector, ship, worker_cache

#: States that the transducer keeps, and words whose ids a worker remembers; both start anew when full.
MAX_STATES = 200_000
MAX_WORDS = 400_000
#: Characters of text handled at once in a worker.
CHUNK_CHARS = 1_000_000
#: Ids that the streaming decoder gets at a time.
STREAM_IDS = 1024


#: Letters and numbers that Unicode gained after version 16, as ranges of code points.
#: The tiktoken library classes them as neither; the regex module knows them already.
NEWER = """
558-558 58b-58c 88f-88f c5c-c5c cdc-cdc 208f-208f 209d-209f a7ce-a7cf a7d2-a7d2 a7d4-a7d4 a7dd-a7dd a7e2-a7e2 a7f1-a7f1
ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a-11b0a 11db0-11ddb 11de0-11de9 11df1-11df1 1246f-1246f
12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191
191a0-191d2 1b123-1b128 1b168-1b168 1d6a6-1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2
1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e-2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f
"""
#: Nothing below the first of them needs the longer search.
_HIGH = re.compile("[\u0558-\U0010ffff]")
_NEWER = re.compile("[" + "".join(f"\\U{int(a, 16):08x}-\\U{int(b, 16):08x}" for a, b in (x.split("-") for x in NEWER.split())) + "]")


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """A rank file: one base64 token and its id on each line."""
    return {base64.b64decode(t): int(i) for t, i in (line.split() for line in data.splitlines() if line.strip())}


class Transducer:
    """Left-to-right BPE over the bytes of one piece.

    A sequence of tokens is the merge result of its bytes exactly if every two neighbours are the
    merge result of their own bytes. So the merges compile to a nondeterministic transducer
    whose configurations are (last token, place in the token trie); completing a token that may
    follow the last one is a step without input. Determinised on demand, a state is the set of
    live configurations, each with the tokens it has completed but not yet emitted; what all
    agree on is emitted. Exactly one configuration completes at each byte, and those that
    started earlier die after the longest token at most: the lookahead is bounded.
    """

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        self.ranks, self.max_states = ranks, max_states
        self.vocab = {i: t for t, i in ranks.items()}
        self.children: list[dict[int, int]] = [{}]
        self.token = [-1]
        for t, i in ranks.items():
            node = 0
            for b in t:
                nxt = self.children[node].get(b)
                if nxt is None:
                    nxt = len(self.children)
                    self.children[node][b] = nxt
                    self.children.append({})
                    self.token.append(-1)
                node = nxt
            self.token[node] = i
        self._spines: dict[tuple[int, bool], list | None] = {}
        self._pairs: dict[tuple[int, int], bool] = {}
        self._reset()

    def _reset(self) -> None:
        start = ((-1, 0, ()),)
        self.states: list[tuple] = [start]
        self.index = {start: 0}
        #: (state << 8 | byte) -> next state and the tokens that are emitted.
        self.steps: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.final: list[tuple[int, ...] | None] = [()]
        if len(self._pairs) > 10 * self.max_states:
            self._pairs.clear()

    def merge(self, piece: bytes) -> list[int]:
        """The definition: merge the neighbours of lowest rank, leftmost first, until none is left."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.ranks[p] for p in parts]

    def _spine(self, token: int, right: bool) -> list[tuple[int, bytes]] | None:
        """The parts that stand at one end of a token while it is merged: (rank that made it, part).

        None for a token that its own bytes do not merge to: it never appears inside a piece.
        """
        key = (token, right)
        if key in self._spines:
            return self._spines[key]
        whole = self.vocab[token]
        parts = [whole[i : i + 1] for i in range(len(whole))]
        end = -1 if right else 0
        out = [(-1, parts[end])]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if parts[end] != out[-1][1]:
                out.append((rank, parts[end]))
        self._spines[key] = found = out if len(parts) == 1 else None
        return found

    def _may_follow(self, last: int, token: int) -> bool:
        """Whether the bytes of ``last`` and ``token`` together merge to just these two.

        Until both are whole, the parts at the boundary change in order of rank; a merge across
        the boundary must come before the next of these changes (on equal ranks the left one
        comes first).
        """
        b = self._spine(token, False)
        if b is None or last < 0:
            return b is not None
        a = self._spine(last, True)
        i = j = 0
        while True:
            next_a = a[i + 1][0] if i + 1 < len(a) else 1 << 60
            next_b = b[j + 1][0] if j + 1 < len(b) else 1 << 60
            across = self.ranks.get(a[i][1] + b[j][1], 1 << 60)
            if across < next_a and across <= next_b and across < 1 << 60:
                return False
            if next_a == next_b == 1 << 60:
                return True
            if next_a <= next_b:
                i += 1
            else:
                j += 1

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        live, done, pairs, children, token = [], None, self._pairs, self.children, self.token
        for last, node, pending in self.states[state]:
            nxt = children[node].get(byte)
            if nxt is None:
                continue
            if children[nxt]:
                live.append((last, nxt, pending))
            t = token[nxt]
            if t >= 0:
                ok = pairs.get((last, t))
                if ok is None:
                    ok = pairs[last, t] = self._may_follow(last, t)
                if ok:
                    done = (t, 0, (*pending, t))
        if done is not None:
            live.append(done)
        if not live:
            raise LookupError
        # what all live configurations have completed is emitted
        emitted = live[0][2]
        for _, _, pending in live:
            if emitted != pending[: len(emitted)]:
                n = 0
                while n < len(emitted) and n < len(pending) and emitted[n] == pending[n]:
                    n += 1
                emitted = emitted[:n]
            if not emitted:
                break
        n = len(emitted)
        key = tuple([(last, node, pending[n:]) for last, node, pending in live]) if n else tuple(live)
        to = self.index.get(key)
        if to is None:
            to = self.index[key] = len(self.states)
            self.states.append(key)
            done = [pending for _, node, pending in key if node == 0]
            self.final.append(done[0] if len(done) == 1 else None)
        out = self.steps[state << 8 | byte] = (to, emitted)
        return out

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.states) > self.max_states:
            self._reset()
        steps, state, out = self.steps, 0, []
        try:
            for b in piece:
                nxt = steps.get(state << 8 | b)
                if nxt is None:
                    nxt = self._step(state, b)
                    if len(self.states) > 2 * self.max_states:  # within one very long piece
                        key = self.states[nxt[0]]
                        self._reset()
                        steps, nxt = self.steps, (self._place(key), nxt[1])
                state, emitted = nxt
                if emitted:
                    out.extend(emitted)
            rest = self.final[state]
        except LookupError:
            rest = None
        if rest is None:  # a vocabulary whose tokens are not all made by its merges
            return self.merge(piece)
        out.extend(rest)
        return out

    def _place(self, key: tuple) -> int:
        if key not in self.index:
            self.index[key] = len(self.states)
            self.states.append(key)
            done = [pending for _, node, pending in key if node == 0]
            self.final.append(done[0] if len(done) == 1 else None)
        return self.index[key]


class Utf8Stream:
    """Incremental UTF-8: feed bytes in any cuts, get the text that is complete.

    The state is how many continuation bytes are due and the range of the next one; bytes of a
    character that is cut wait. Malformed input gives U+FFFD for each maximal subpart.
    """

    def __init__(self):
        self.due, self.low, self.high, self.wait = 0, 0x80, 0xBF, b""

    def _advance(self, b: int) -> bool:
        """One byte; False if it cannot follow."""
        if self.due:
            if not self.low <= b <= self.high:
                return False
            self.due, self.low, self.high = self.due - 1, 0x80, 0xBF
            return True
        if b < 0x80:
            return True
        if 0xC2 <= b <= 0xDF:
            self.due = 1
        elif 0xE0 <= b <= 0xEF:
            self.due, self.low, self.high = 2, 0xA0 if b == 0xE0 else 0x80, 0x9F if b == 0xED else 0xBF
        elif 0xF0 <= b <= 0xF4:
            self.due, self.low, self.high = 3, 0x90 if b == 0xF0 else 0x80, 0x8F if b == 0xF4 else 0xBF
        else:
            return False
        return True

    def feed(self, data: bytes) -> str:
        data = self.wait + data
        # only the last character can be cut: start from the last lead byte among the last three
        at = len(data)
        for back in range(1, min(3, len(data)) + 1):
            if data[-back] & 0xC0 != 0x80:
                at = len(data) - back
                break
        self.due, self.low, self.high = 0, 0x80, 0xBF
        cut = len(data)
        if all(self._advance(b) for b in data[at:]) and self.due:
            cut = at
        else:
            self.due = 0
        self.wait = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.wait, self.due = self.wait, b"", 0
        return rest.decode("utf-8", "replace")


class Codec:
    """Whole texts to ids and back."""

    def __init__(self, rank_data: bytes, pattern: str):
        self.fst = Transducer(parse_ranks(rank_data))
        self.split = regex.compile(pattern)
        self.words: dict[str, bytes] = {}
        size = max(self.fst.vocab) + 1
        tokens = [self.fst.vocab.get(i, b"") for i in range(size)]
        self.token_len = np.array([len(t) for t in tokens], np.int64)
        self.token_at = np.concatenate([[0], np.cumsum(self.token_len)[:-1]])
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text: every match of the pattern on its own; a distinct piece is encoded once."""
        pieces: list[str] = []
        ends = []
        for t in texts:
            high = None if t.isascii() else _HIGH.search(t)
            if high and _NEWER.search(t, high.start()):  # stand-ins of no class, one for one
                pieces.extend(t[m.start() : m.end()] for m in self.split.finditer(_NEWER.sub("\ue000", t)))
            else:
                pieces.extend(self.split.findall(t))
            ends.append(len(pieces))
        if not pieces:
            return [np.empty(0, np.uint32) for _ in texts]
        if len(self.words) > MAX_WORDS:
            self.words.clear()
        words, encode = self.words, self.fst.encode
        ids = list(map(words.get, pieces))
        if None in ids:
            long: dict[str, bytes] = {}  # too long to keep beyond this call
            for i, got in enumerate(ids):
                if got is None:
                    u = pieces[i]
                    kept = words if len(u) <= 64 else long
                    got = kept.get(u)
                    if got is None:
                        got = kept[u] = array("I", encode(u.encode("utf-8"))).tobytes()
                    ids[i] = got
        at = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids))) // 4
        out = np.frombuffer(b"".join(ids), np.uint32)
        ends = np.array(ends)
        bounds = np.where(ends > 0, at[ends - 1], 0)
        return np.split(out, bounds[:-1])

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        ids = ids.astype(np.int64)
        lens = self.token_len[ids]
        at = np.concatenate([[0], np.cumsum(lens)])
        where = np.repeat(self.token_at[ids] - at[:-1], lens)
        where += np.arange(at[-1])
        return self.token_bytes[where].tobytes()

    def decode_stream(self, ids: Iterable[np.ndarray]) -> Iterator[str]:
        """Text as ids arrive, in any cuts; the pieces join to the whole text."""
        s = Utf8Stream()
        for block in ids:
            yield s.feed(self.decode_bytes(np.asarray(block)))
        yield s.close()

    def decode_many(self, ids: list[np.ndarray], block: int = STREAM_IDS) -> Iterator[Iterator[str]]:
        """For each text the pieces that the UTF-8 machine gives when its ids arrive ``block`` at a time.

        The bytes of all tokens are looked up at once; where they are cut is where blocks of ids end.
        """
        flat = np.concatenate([*ids, np.empty(0, np.uint32)])
        data = self.decode_bytes(flat)
        at = np.concatenate([[0], np.cumsum(self.token_len[flat.astype(np.int64)])])
        first = 0
        for x in ids:
            cuts = at[np.append(np.arange(first, first + len(x), block), first + len(x))].tolist()
            first += len(x)
            yield self._pieces(data, cuts)

    @staticmethod
    def _pieces(data: bytes, cuts: list[int]) -> Iterator[str]:
        s = Utf8Stream()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield s.feed(data[a:b])
        yield s.close()


def text_digest(pieces: Iterable[str]) -> str:
    """SHA-256 of a text that comes in pieces."""
    h = hashlib.sha256()
    for p in pieces:
        h.update(p.encode())
    return h.hexdigest()


_codecs: dict[str, Codec] = worker_cache()


def _codec(data: bytes, pattern: str) -> Codec:
    key = hashlib.sha256(data + pattern.encode()).hexdigest()
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(data, pattern)
    return _codecs[key]


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, *, id_col="doc_id", text_col="text", keep: str = "digests") -> DataFrame:
    """Encode every whole text and decode it again.

    ``rank_file`` is read on the driver and broadcast (one vocabulary, about 1 MB). With
    ``keep="ids"`` the result has doc_id, ids (array<int>) and text (decoded); with "digests"
    doc_id, n_tokens, ids_sha256 (little-endian uint32) and decoded_sha256. Null texts count as
    empty: no ids. One row for each row in, repeated rows included; other columns are not read.
    Special tokens are not recognised: their strings are ordinary text. Texts are taken in
    chunks of about ``CHUNK_CHARS`` characters, a very long one alone.
    """
    spark = docs.sparkSession
    ship(spark)
    bounded_batches(spark)
    with open(rank_file, "rb") as f:
        data = spark.sparkContext.broadcast(f.read())
    digests = keep == "digests"
    if digests:
        schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
        ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    else:
        schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("text", pa.string())])
        ddl = "doc_id long, ids array<int>, text string"

    def run(batches):
        codec = _codec(data.value, pattern)
        with paused_collector():  # the tables hold no cycles, and scanning them costs more than encoding
            for batch in batches:
                rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
                for part in chunks(rows, lambda r: len(r[1] or ""), CHUNK_CHARS):
                    ids = codec.encode_many([t or "" for _, t in part])
                    cols = [[i for i, _ in part]]
                    if digests:
                        cols.append([len(x) for x in ids])
                        cols.append([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids])
                        cols.append([text_digest(pieces) for pieces in codec.decode_many(ids)])
                    else:
                        cols.append([x.astype(np.int32) for x in ids])
                        cols.append(["".join(pieces) for pieces in codec.decode_many(ids)])
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, ddl)
