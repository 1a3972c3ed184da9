"""Token ids of documents as binary files, in ascending order of document ids, and back.

Rows are dealt to ranges of ids, each task encodes its range and writes one file (format:
:mod:`wavemill.llm.frames`), and a manifest lists the files. Readers go through the manifest and read
one file, or only chosen documents' frames, in a task.

White space never is part of a token of this tokenizer's vocabulary, and no token spans it, so each
distinct stretch between white space is encoded once and remembered. The tokenizer lower-cases, and
parts letters and digits from closing marks, so a stretch takes the ids of its core and of its marks.

Defined results: a null text counts as empty, and an empty one is the end id alone; a null id comes
first; rows that repeat an id stay beside each other, ordered by text; an empty table gives no files and
an empty result; further columns are ignored. A task that is run again writes another file; the
manifest names the one of the attempt that was committed.
"""

from __future__ import annotations

import os
import string
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.llm.frames import Reader, Writer
from wavemill.llm.shared import bounded_batches, held_in_worker, require_columns, shared_folder, task_slots

END_ID = 2
#: Bytes of files that one task reads, at least: small files are read together.
READ_BYTES = 16 << 20
#: Texts encoded together; more of them share more of what is looked up.
ROWS = 2500
#: Distinct stretches remembered in a worker, in two generations: the older is dropped when the newer is
#: half of this, and what was used since is kept.
REMEMBERED = 600_000
#: Characters of texts that are encoded whole: the divider below, controls that pyarrow takes for white space but
#: the tokenizer doesn't, the first character of its special tokens, and marks that
#: compose with ASCII letters or come out of lower-casing.
UNSAFE = "[\\x01\\x1c-\\x1f<\u0130\u0300-\u036f]"
#: Between stretches that are encoded together: one token that only this character gives.
DIVIDER_MARK = "\x01"
DIVIDER = f"\n{DIVIDER_MARK}\n"
_LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
#: After a letter or digit these surely begin a token.
MARKS = ".,;:!?"


def _lowered(texts: pa.Array) -> pa.Array:
    """A-Z to a-z in all bytes at once (``pyarrow.compute.ascii_lower`` harms other bytes of sliced arrays)."""
    _, offsets, data = texts.buffers()
    if data is None or not data.size:
        return texts
    return pa.LargeStringArray.from_buffers(len(texts), offsets, pa.py_buffer(data.to_pybytes().translate(_LOWER)), offset=texts.offset)


class StretchEncoder:
    """Encodes texts with a ``tokenizers`` file whose pre-tokenizer drops white space."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        self.tok.no_truncation()
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        (self.divider,) = self.tok.encode(DIVIDER_MARK, add_special_tokens=False).ids

    def _whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _encoded(self, stretches: list[str]) -> None:
        """Remember ids of stretches, encoded as one text with the divider between them."""
        ids = np.array(self.tok.encode_batch_fast([DIVIDER.join(stretches)], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.flatnonzero(ids == self.divider)
        if len(cuts) != len(stretches) - 1:
            raise ValueError("the divider isn't a token of its own")
        raw, starts, ends = ids.tobytes(), [0, *((cuts + 1) * 4).tolist()], [*(cuts * 4).tolist(), 4 * len(ids)]
        self.known.update(zip(stretches, [raw[i:j] for i, j in zip(starts, ends)]))

    def _known(self, stretches: list[str]) -> list[bytes]:
        """Ids of distinct stretches; those of plain ones are made of their core's and of their closing marks'."""
        if len(self.known) > REMEMBERED // 2:
            self.known, self.older = {}, self.known
        known, older, new, ends = self.known, self.older, set(), []
        for w in stretches:
            core = w.rstrip(MARKS)
            if core != w and core and core[-1].isalnum():
                tail = w[len(core) :]
            else:
                core, tail = w, ""
            ends.append((core, tail))
            for x in (core, tail) if tail else (core,):
                if x not in known:
                    if x in older:
                        known[x] = older[x]
                    else:
                        new.add(x)
        todo = list(new)
        for i in range(0, len(todo), 10_000):
            self._encoded(todo[i : i + 10_000])
        return [known[core] + known[tail] if tail else known[core] for core, tail in ends]

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text. Texts with an UNSAFE character are encoded as they are, without the memory."""
        texts = pa.concat_arrays([texts.cast(pa.large_string()).fill_null("")])
        unsafe = pc.match_substring_regex(texts, UNSAFE)
        if pc.any(unsafe).as_py():
            whole = {i: self._whole(texts[i].as_py()) for i in pc.indices_nonzero(unsafe).to_pylist()}
            rest = self._encode(pc.if_else(unsafe, "", texts))
            return [whole.get(i, r) for i, r in enumerate(rest)]
        return self._encode(texts)

    def _encode(self, texts: pa.Array) -> list[bytes]:
        parts = pc.utf8_split_whitespace(_lowered(texts))
        coded = parts.flatten().dictionary_encode()
        bounds = np.concatenate(([0], np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False)))).astype(np.int64)
        raws = self._known(coded.dictionary.to_pylist())
        ids = np.frombuffer(b"".join(raws), "<u4")
        sizes = np.fromiter(map(len, raws), np.int64, len(raws)) // 4
        starts = np.cumsum(sizes) - sizes
        at = coded.indices.to_numpy(zero_copy_only=False)
        n = sizes[at]
        before = np.concatenate(([0], np.cumsum(n)))
        out = ids[np.repeat(starts[at] - before[:-1], n) + np.arange(before[-1])] if before[-1] else ids[:0]
        cuts = before[bounds].tolist()
        return [out[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:])]


def encoder(path: str) -> StretchEncoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return held_in_worker(StretchEncoder, path)


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


MANIFEST = "path string, first_id long, documents long, ids long, bytes long"


def write_tokens(
    docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, files: int | None = None
) -> DataFrame:
    """Write the files into ``folder`` (a uri that all executors reach); the manifest, which is stored there too."""
    require_columns(docs, [id_col, text_col])
    bounded_batches(docs.sparkSession, ROWS)
    spark = docs.sparkSession
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        enc, out, w, path, size, first = encoder(tokenizer), None, None, "", 0, None
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for a in range(0, len(ids), ROWS):
                if out is None and ids:
                    fs.create_dir(root, recursive=True)
                    path, first = f"{root}/{uuid.uuid4().hex}.ids.zst", ids[0]
                    out = fs.open_output_stream(path, compression=None)
                    w = Writer(out.write)
                for i, raw in zip(ids[a : a + ROWS], enc.encode(batch.column(1).slice(a, ROWS)), strict=True):
                    w.add(i, raw + end)
        if out is not None:
            w.close()
            size = out.tell()
            out.close()
            row = [path], [first], [len(w.ids)], [sum(w.counts)], [size]
            kinds = pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds)], names=["path", "first_id", "documents", "ids", "bytes"])

    dealt = (
        docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
        .repartitionByRange(files or task_slots(spark), F.col("id").asc_nulls_first())
        .sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
    )
    # A row for each file: what the driver gets, and stores as one small file, grows with the files, not with the documents.
    rows = [tuple(r) for r in dealt.mapInArrow(run, MANIFEST).collect()]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_tokens(manifest: DataFrame, folder: str, wanted: list[int] | None = None) -> DataFrame:
    """doc_id, start, ids for all documents, or the ``wanted`` ones. ``start``: ids of all documents before."""
    spark = manifest.sparkSession
    files = sorted(manifest.collect(), key=lambda r: (r.first_id is not None, r.first_id or 0, r.path))
    rows, at, size, task = [], 0, 0, 0
    for r in files:
        rows.append((r.path, at, r.bytes, task))
        at, size = at + r.ids, size + r.bytes
        if size >= READ_BYTES:
            size, task = 0, task + 1
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _open(folder)
        for batch in batches:
            for path, base, size in zip(*(batch.column(i).to_pylist() for i in range(3))):
                with fs.open_input_file(path) as f:

                    def get(offset: int, n: int, f=f) -> bytes:
                        f.seek(offset)
                        return f.read(n)

                    held, weight = [], 0
                    for d in Reader(get, size).documents(wanted):
                        raw = d.ids.tobytes()
                        held.append((d.doc_id, base + d.start, raw))
                        weight += len(raw)
                        if weight > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)
                            held, weight = [], 0
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)

    listed = spark.createDataFrame(rows, "path string, base long, bytes long, place int")
    dealt = listed.repartitionById(task + 1, F.col("place"))
    return dealt.mapInArrow(run, "doc_id long, start long, ids binary")


def new_folder(docs: DataFrame) -> str:
    return f"{shared_folder(docs.sparkSession).rstrip('/')}/tokens-{uuid.uuid4().hex}"
