"""Operator 10, byte-level BPE encoding and decoding: recursive DuckDB queries, one database for each partition."""

from __future__ import annotations

import base64
import ctypes
import ctypes.util
from collections.abc import Iterator

import ahocorasick
import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DataType, StructField, StructType

from tarnlight.llm.common import free_name, quoted, read

#: A vocabulary of byte-level BPE: a token in base64 and its rank on each line. Executors need not have it.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: How a text is cut into words before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts without two white space characters in a row and with ASCII white space only, where RE2 needs no lookahead.
PLAIN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
NOT_PLAIN = r"\s\s|[\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Bytes of text encoded at a time, rows at most that one query can hold, ids decoded by one query, and words whose encoding a
#: partition remembers.
CHUNK_BYTES, QUERY_ROWS, QUERY_IDS, REMEMBERED = 2 << 20, 1_500_000, 1 << 18, 300_000
#: What one database may hold, and what it may hold besides for each byte of the longest word.
DATABASE_MB, BYTES_A_BYTE = 160, 1_000
#: Words of more bytes are first cut where no token of the vocabulary stands across; what is left of more bytes takes MANY steps a query.
LONG_WORD, MANY = 64, 8

#: Token-position rows join the merge table; in each word that still has a pair to merge, the leftmost of least rank is
#: contracted and later positions move up by one. A word without such a pair adds no more rows: its last ones are its tokens.
ENCODE = """
WITH RECURSIVE bpe(step, word, pos, token, pair) AS (
  SELECT 0, word, pos, token, m.merged FROM (SELECT *, lead(token) OVER (PARTITION BY word ORDER BY pos) AS next FROM start) LEFT JOIN merges m ON m.a = token AND m.b = next
  UNION ALL
  SELECT step, word, pos, token, m.merged FROM (
    SELECT step, word, pos, token, lead(token) OVER (PARTITION BY word ORDER BY pos) AS next FROM (
      SELECT b.step + 1 AS step, b.word, b.pos - (b.pos > k.pos)::INT AS pos, CASE WHEN b.pos = k.pos THEN k.merged ELSE b.token END AS token
      FROM bpe b JOIN (
        SELECT word, (min(pair::BIGINT << 32 | pos) & 4294967295)::INT AS pos, (min(pair::BIGINT << 32 | pos) >> 32)::INT AS merged
        FROM bpe WHERE pair IS NOT NULL GROUP BY word) k ON k.word = b.word
      WHERE b.pos <> k.pos + 1)) LEFT JOIN merges m ON m.a = token AND m.b = next),
last AS (SELECT word, max(step) AS step FROM bpe GROUP BY word)
SELECT list(token ORDER BY pos) AS ids FROM bpe JOIN last USING (word, step) GROUP BY word ORDER BY word
"""
START = """
CREATE OR REPLACE TEMP TABLE start AS
SELECT word, i::INT AS pos, token
FROM (SELECT word, unnest(range(octet_length(bytes))) AS i, hex(bytes) AS h FROM new_words) JOIN single ON hexed = substr(h, (2 * i + 1)::BIGINT, 2)
"""
#: The same for one long word, in one step besides the leftmost pair of least rank all pairs that this rule is certain to
#: contract later, whatever comes before. places has all [first, after) where the word's bytes are a token; a later token can only
#: be one that begins and ends where present ones do. A pair is certain where, of those, none that ends with the left token and
#: is longer ranks below it or alike, and none that begins with the right token and is longer ranks below it. Of pairs of one
#: rank in a row every second is, where the first is and only the one before ranks alike. So the steps don't grow with the word.
#: Each query takes MANY steps and leaves the last one's rows, in which the next one begins.
ENCODE_LONG = f"""
CREATE OR REPLACE TEMP TABLE tokens_now AS
WITH RECURSIVE bpe(step, first, after, token) AS (
  SELECT 0, first, after, token FROM tokens_before
  UNION ALL
  SELECT step + 1, first, CASE WHEN hit THEN next_after ELSE after END, CASE WHEN hit THEN merged ELSE token END FROM (
    SELECT *, lag(hit, 1, false) OVER (ORDER BY first) AS gone FROM (
      SELECT *, sure AND (nth - min(nth) OVER (PARTITION BY chain)) % 2 = 0 AND (bool_or(begins) OVER (PARTITION BY chain)) AS hit FROM (
        SELECT *, count(*) FILTER (begins OR NOT sure OR merged IS DISTINCT FROM before) OVER (ORDER BY first ROWS UNBOUNDED PRECEDING) AS chain FROM (
          SELECT *, coalesce(low_left >= merged AND low_right >= merged, false) OR begins AS sure FROM (
            SELECT *, lag(merged) OVER w AS before, row_number() OVER w AS nth,
              coalesce((low_left > merged AND low_right >= merged) OR (merged::BIGINT << 32 | first) = min(merged::BIGINT << 32 | first) OVER (), false) AS begins,
              min(merged) OVER () AS least FROM (
              SELECT b.*, m.merged, coalesce(l.low, 2147483647) AS low_left, coalesce(r.low, 2147483647) AS low_right FROM (
                SELECT *, lead(token) OVER v AS next, lead(after) OVER v AS next_after FROM bpe WHERE step < {MANY} WINDOW v AS (ORDER BY first)) b
              LEFT JOIN merges m ON m.a = b.token AND m.b = b.next
              LEFT JOIN (SELECT y.after, min(o.token) AS low FROM places o JOIN bpe y ON y.after = o.after AND o.first < y.first SEMI JOIN bpe x ON x.first = o.first GROUP BY y.after) l ON l.after = b.after
              LEFT JOIN (SELECT x.first, min(o.token) AS low FROM places o JOIN bpe x ON x.first = o.first AND o.after > x.after SEMI JOIN bpe y ON y.after = o.after GROUP BY x.first) r ON r.first = b.after)
            WINDOW w AS (ORDER BY first)))))
    WHERE least IS NOT NULL)
  WHERE NOT gone)
SELECT * FROM bpe WHERE step = (SELECT max(step) FROM bpe)
"""
#: Ordered aggregation: the bytes of a document's tokens in their order; an unknown id makes the document null.
DECODE = """
SELECT doc, CASE WHEN count(hexed) = count(*) THEN unhex(string_agg(hexed, '' ORDER BY pos)) END AS bytes
FROM tokens LEFT JOIN vocabulary USING (token) GROUP BY doc ORDER BY doc
"""


def load_vocabulary(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Coder:
    """Encodes and decodes columns in a DuckDB database of its own. Small enough to be sent to tasks; the database is opened there."""

    def __init__(self, vocabulary: dict[bytes, int]):
        rows = [(vocabulary[t[:i]], vocabulary[t[i:]], rank) for t, rank in vocabulary.items() for i in range(1, len(t)) if t[:i] in vocabulary and t[i:] in vocabulary]
        m = np.array(rows, np.int32).reshape(-1, 3)
        self.merges = pa.table({"a": m[:, 0], "b": m[:, 1], "merged": m[:, 2]})
        self.tokens = pa.table({"token": pa.array(vocabulary.values(), pa.int32()), "hexed": [t.hex().upper() for t in vocabulary]})
        missing = [b for b in range(256) if bytes([b]) not in vocabulary]
        if missing:
            raise ValueError(f"not a byte-level vocabulary: no token for bytes {missing[:5]}")
        self.db = self.finder = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"db": None, "finder": None}

    def _open(self) -> duckdb.DuckDBPyConnection:
        if self.db is None:
            _trim()
            self.db = duckdb.connect(config={"threads": 1, "memory_limit": f"{DATABASE_MB}MB", "temp_directory": ""})
            for name, table in (("merges", self.merges), ("vocabulary", self.tokens)):
                self.db.register("given", table)
                self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
                self.db.unregister("given")
            self.db.execute("CREATE TABLE single AS SELECT token, hexed FROM vocabulary WHERE length(hexed) = 2")
            self._forget()
        return self.db

    def close(self) -> None:
        """Gives the database's memory, and what else was freed, back to the system: a worker process runs many tasks."""
        if self.db is not None:
            self.db.close()
        self.db = self.finder = None
        _trim()

    def _forget(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.ids = pa.array([], pa.list_(pa.int32()))

    def _sql(self, query: str, **tables: pa.Table) -> pa.Table:
        db = self._open()
        for name, table in tables.items():
            db.register(name, table)
        out = db.sql(query)
        out = out.to_arrow_table() if out is not None else None
        for name in tables:
            db.unregister(name)
        return out

    def split(self, texts: pa.Array) -> pa.ListArray:
        """The words of each text (not null); together they are the text."""
        plain = self._sql(f"SELECT CASE WHEN regexp_matches(text, '{NOT_PLAIN}') THEN NULL ELSE regexp_extract_all(text, '{PLAIN_PATTERN.replace(chr(39), chr(39) * 2)}') END AS words FROM texts", texts=pa.table({"text": texts}))["words"].combine_chunks()
        plain = plain.cast(pa.large_list(pa.large_string()))
        if not plain.null_count:
            return plain
        cut = regex.compile(PATTERN)
        other = pa.array([None if valid else cut.findall(t.as_py()) for valid, t in zip(plain.is_valid().to_pylist(), texts)], pa.large_list(pa.large_string()))
        return pc.coalesce(plain, other)

    def _encode_words(self, words: pa.Array) -> pa.Array:
        """Token ids of each distinct word."""
        words = words.cast(pa.large_binary())
        size = pc.binary_length(words).to_numpy()
        long = np.flatnonzero(size > LONG_WORD)
        if not len(long):
            return self._encode_short(words)
        cut = [self._cut(w) for w in words.take(pa.array(long)).to_pylist()]
        pieces = pa.array([p for some in cut for p in some], pa.large_binary()).dictionary_encode()
        length = pc.binary_length(pieces.dictionary).to_numpy()
        some, rest = np.flatnonzero(length <= LONG_WORD), np.flatnonzero(length > LONG_WORD)
        both = [self._encode_short(pieces.dictionary.take(pa.array(some))), *(self._encode_long(w) for w in pieces.dictionary.take(pa.array(rest)).to_pylist())]
        each = pa.concat_arrays(both).take(pa.array(np.argsort(np.concatenate([some, rest])))).take(pieces.indices)
        ends = np.concatenate([[0], np.cumsum(each.value_lengths().to_numpy())])[np.cumsum([0, *map(len, cut)])]
        short = np.flatnonzero(size <= LONG_WORD)
        out = pa.concat_arrays([self._encode_short(words.take(pa.array(short))), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), each.flatten())])
        return out.take(pa.array(np.argsort(np.concatenate([short, long]))))

    def _encode_short(self, words: pa.Array) -> pa.Array:
        # a word of n bytes has at most n (n + 1) / 2 rows in a query
        size = pc.binary_length(words).to_numpy().astype(np.int64)
        rows, out, a = np.cumsum(size * (size + 1) // 2), [pa.array([], pa.list_(pa.int32()))], 0
        while a < len(words):
            b = max(a + 1, int(np.searchsorted(rows, (rows[a - 1] if a else 0) + QUERY_ROWS)))
            self._sql(START, new_words=pa.table({"word": np.arange(b - a), "bytes": words.slice(a, b - a)}))
            out.append(self._sql(ENCODE)["ids"].combine_chunks().cast(pa.list_(pa.int32())))
            a = b
        return pa.concat_arrays(out)

    def _places(self, word: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First byte, byte after the last, and rank of each token that the word's bytes hold anywhere."""
        if self.finder is None:
            self.finder = ahocorasick.Automaton()
            for h, token in zip(self.tokens["hexed"].to_pylist(), self.tokens["token"].to_pylist()):
                self.finder.add_word(bytes.fromhex(h).decode("latin-1"), (len(h) // 2, token))
            self.finder.make_automaton()
        found = np.array([(at + 1 - n, at + 1, token) for at, (n, token) in self.finder.iter(word.decode("latin-1"))], np.int64)
        return found[:, 0], found[:, 1], found[:, 2]

    def _cut(self, word: bytes) -> list[bytes]:
        """The word in pieces, cut wherever no token stands across: no merge can."""
        first, after, _ = self._places(word)
        over = np.zeros(len(word) + 1, np.int64)
        np.add.at(over, first + 1, 1)
        np.add.at(over, after, -1)
        at = [0, *np.flatnonzero(np.cumsum(over)[1 : len(word)] == 0) + 1, len(word)]
        return [word[a:b] for a, b in zip(at, at[1:])]

    def _encode_long(self, word: bytes) -> pa.Array:
        """A list with the token ids of one long word."""
        first, after, token = self._places(word)
        db = self._open()
        db.execute(f"SET memory_limit = '{DATABASE_MB + len(word) * BYTES_A_BYTE // 1_000_000}MB'")
        self._sql("CREATE OR REPLACE TEMP TABLE places AS SELECT first::INT AS first, after::INT AS after, token::INT AS token FROM given", given=pa.table({"first": first, "after": after, "token": token}))
        db.execute("CREATE OR REPLACE TEMP TABLE tokens_before AS SELECT first, after, token FROM places WHERE after = first + 1")
        while True:
            db.execute(ENCODE_LONG)
            if db.sql("SELECT max(step) AS step FROM tokens_now").fetchall()[0][0] < MANY:
                break
            db.execute("CREATE OR REPLACE TEMP TABLE tokens_before AS SELECT first, after, token FROM tokens_now")
        ids = self._sql("SELECT token FROM tokens_now ORDER BY first")["token"].combine_chunks().cast(pa.int32())
        for table in ("places", "tokens_before", "tokens_now"):
            db.execute(f"DROP TABLE {table}")
        db.execute(f"SET memory_limit = '{DATABASE_MB}MB'")
        return pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)

    def encode(self, texts: pa.Array) -> pa.Array:
        """Token ids of each text; null for null, none for an empty text."""
        out = []
        for part in _chunks(texts):
            self._open()
            whole = pc.fill_null(part.cast(pa.large_string()), "")
            words = self.split(whole)
            flat = words.flatten().dictionary_encode()
            at = pc.index_in(flat.dictionary, self.known)
            new = flat.dictionary.filter(at.is_null())
            if len(self.known) + len(new) > REMEMBERED and len(self.known):
                self._forget()
                at, new = pc.index_in(flat.dictionary, self.known), flat.dictionary
            if len(new):
                self.ids = pa.concat_arrays([self.ids, self._encode_words(new)])
                self.known = pa.concat_arrays([self.known, new])
                at = pc.index_in(flat.dictionary, self.known)
            each = self.ids.take(at.take(flat.indices))
            ends = np.concatenate([[0], np.cumsum(each.value_lengths().to_numpy())])
            offsets = words.offsets.to_numpy() - words.offsets[0].as_py()
            rows = pa.ListArray.from_arrays(pa.array(ends[offsets].astype(np.int32)), each.flatten())
            out.append(pc.if_else(part.is_valid(), rows, pa.scalar(None, rows.type)) if part.null_count else rows)
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int32()))

    def decode(self, ids: pa.Array) -> pa.Array:
        """The bytes of each list of ids; null for null and where an id is null or unknown. Lists of any length, QUERY_IDS ids a query."""
        flat = ids.flatten()
        doc = pc.list_parent_indices(ids).to_numpy()
        parts = []
        for a in range(0, len(flat), QUERY_IDS):
            here = doc[a : a + QUERY_IDS]
            parts.append(self._sql(DECODE, tokens=pa.table({"doc": here, "pos": np.arange(len(here)), "token": flat.slice(a, QUERY_IDS)})))
        if not parts:
            return pc.if_else(ids.is_valid(), pa.scalar(b"", pa.large_binary()), pa.scalar(None, pa.large_binary()))
        got = pa.concat_tables(parts)
        owner, found = got["doc"].to_numpy().astype(np.int64), got["bytes"].combine_chunks().cast(pa.large_binary())
        if isinstance(found, pa.ChunkedArray):
            found = found.combine_chunks()
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        if len(first) < len(owner):  # a list that was cut
            lists = pa.LargeListArray.from_arrays(pa.array(np.r_[first, len(owner)]), found)
            found, owner = pc.binary_join(lists, pa.scalar(b"", pa.large_binary())), owner[first]
        text = found.take(pc.index_in(pa.array(np.arange(len(ids))), pa.array(owner)))
        return pc.if_else(pc.fill_null(pc.equal(pc.list_value_length(ids), 0), False), pa.scalar(b"", pa.large_binary()), text)


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    name = ctypes.util.find_library("c")
    trim = getattr(ctypes.CDLL(name), "malloc_trim", None) if name else None
    if trim is not None:
        trim(0)


def _chunks(texts: pa.Array) -> Iterator[pa.Array]:
    for a, b in _ranges(texts):
        yield texts.slice(a, b - a)


def _ranges(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Rows of about CHUNK_BYTES together; a row is never cut."""
    total = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))])
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(total, total[a] + CHUNK_BYTES, "right")) - 1)
        yield a, b
        a = b


def encode(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """All rows and columns of docs with token_ids, the ids of the text: null for a null text, empty for an empty one.

    Special tokens are not looked for: their strings are ordinary text. Repeated rows are encoded alike. A text may be of any
    length, and so may its words: a row is never cut, a long word is. Ties among pairs go to the leftmost. A column of docs
    that is named token_ids keeps its name, the new one then gets underscores before it. Words are merged once for each
    partition that holds them, for as many words as it remembers.
    """
    return _mapped(docs, text, "token_ids", "array<int>", Coder(load_vocabulary(vocabulary)), lambda coder, x: coder.encode(x))


def decode(tokens: DataFrame, ids: str = "token_ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """All rows and columns of tokens with decoded, the text of the ids: null where an id is null or unknown, "\\ufffd" for bytes that aren't UTF-8.

    Null stays null, no ids give an empty text, lists may be of any length, repeated rows are decoded alike. A column of
    tokens that is named decoded keeps its name, the new one then gets underscores before it.
    """

    def text(coder: Coder, x: pa.Array) -> pa.Array:
        found = coder.decode(x)
        try:
            return found.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([v if v is None else v.decode("utf-8", "replace") for v in found.to_pylist()], pa.string())

    return _mapped(tokens, ids, "decoded", "string", Coder(load_vocabulary(vocabulary)), text)


def _mapped(df: DataFrame, column: str, name: str, kind: str, coder: Coder, f) -> DataFrame:
    name, at = free_name(df, name), df.columns.index(column)
    schema = StructType([*df.schema.fields, StructField(name, DataType.fromDDL(kind))])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for whole in batches:
                for a in range(0, whole.num_rows, 500):
                    b = whole.slice(a, 500)
                    yield pa.RecordBatch.from_arrays([*b.columns, f(coder, b.column(at))], names=names)
        finally:
            coder.close()

    return df.mapInArrow(run, schema)


def round_trip(docs: DataFrame, row_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, token_ids, n_tokens, exact): each text encoded and decoded again; exact says whether its bytes came back.

    A null text has null in all three, an empty one no ids. Ids of rows may be null, repeated and of any type; repeated rows
    give repeated rows. Texts and words may be of any length. Other columns of docs, whatever their names, are not carried.
    """
    coder = Coder(load_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for whole in batches:
                for first, end in _ranges(whole.column(1)):
                    b = whole.slice(first, end - first)
                    ids = coder.encode(b.column(1))
                    same = pc.equal(coder.decode(ids), b.column(1).cast(pa.large_binary()))
                    yield pa.RecordBatch.from_arrays([b.column(0), ids, pc.list_value_length(ids), same], names=["doc_id", "token_ids", "n_tokens", "exact"])
        finally:
            coder.close()

    return docs.select(quoted(row_id), quoted(text)).mapInArrow(run, f"doc_id {docs.schema[row_id].dataType.simpleString()}, token_ids array<int>, n_tokens int, exact boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read(spark, sf_dir, "documents"))
