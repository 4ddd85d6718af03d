"""Token counts of flat, unindexed token files by a separator scan.

A token file is nothing but ids of fixed width, each document followed by the end-of-document id.
Files are cut into blocks that any task can read by itself; each block is searched for the
separator with one vectorised comparison. A document that crosses a block boundary is stitched by a
prefix scan over the blocks of its file: the last separator and the number of separators before.

Defined results: null and empty texts are documents of no tokens; ids after the last separator are
one more document; an empty file has none; repeated rows count each; an empty table writes no file
and gives an empty result; other columns are ignored. A file that a lost task left behind is in no
manifest and so is never read.
"""

from __future__ import annotations

import base64
import uuid

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import load, new_path, slices, stage, text_or_empty, tidy

#: Bytes of a token file that one step of a task reads.
BLOCK_BYTES = 8 << 20
WIDTH = 2  # bytes of an id; vocabularies of up to 65536
_encodings: dict = {}


def _open_fs(path: str):
    """The store of a path, and the path in it; local paths may come without a scheme."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def _encoding(path: str):
    if path not in _encodings:
        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        _encodings[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def write_token_files(docs: DataFrame, folder: str, ranks: str, end_id: int = 50256, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode all texts into flat files, one for each task; staged rows (k, file, nth): which document of which file a row became."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        store, root = _open_fs(folder)
        store.create_dir(root, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.bin"
        out, nth = None, 0
        for pdf in batches:
            texts = pdf["t"].tolist()
            for a, b in slices(texts):
                out = out or store.open_output_stream(f"{root}/{name}")
                ids = _encoding(ranks).encode_ordinary_batch(texts[a:b], num_threads=1)
                out.write(np.fromiter((i for doc in ids for i in (*doc, end_id)), f"<u{WIDTH}").tobytes())
                yield pd.DataFrame({"k": pdf["k"].iloc[a:b].values, "file": f"{folder}/{name}", "nth": np.arange(nth, nth + b - a)})
                nth += b - a
        if out:
            out.close()

    rows = docs.select(F.col(key).alias("k"), text_or_empty(text).alias("t"))
    return stage(rows.mapInPandas(tidy(run), f"k {kind}, file string, nth long"), "token-manifest")


def scan_token_files(files: DataFrame, end_id: int = 50256, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """files(file) -> file, nth (document in the file, from 0), start (its first id's place), n_tokens (without the separator)."""
    step = block_bytes // WIDTH

    def sizes(batches):
        for pdf in batches:
            n = []
            for f in pdf["file"]:
                store, path = _open_fs(f)
                n.append(store.get_file_info(path).size // WIDTH)
            yield pd.DataFrame({"file": pdf["file"], "ids": n})

    def search(batches):
        for pdf in batches:
            for f, block, total in zip(pdf["file"], pdf["block"], pdf["ids"]):
                store, path = _open_fs(f)
                at = int(block) * step
                with store.open_input_file(path) as source:
                    data = source.read_at(min(step, int(total) - at) * WIDTH, at * WIDTH)
                ids = np.frombuffer(data, f"<u{WIDTH}")
                ends = np.flatnonzero(ids == end_id) + at
                if at + len(ids) == total and len(ids) and ids[-1] != end_id:
                    ends = np.append(ends, total)
                yield pd.DataFrame({"file": [f], "block": [int(block)], "ends": [ends]})

    known = files.select("file").distinct().mapInPandas(tidy(sizes), "file string, ids long").where("ids > 0")
    blocks = known.select("file", "ids", F.explode(F.sequence(F.lit(0), F.floor((F.col("ids") - 1) / step).cast("int"))).alias("block"))
    # each block once more by itself, so that one large file is read by many tasks
    found = stage(blocks.repartition("file", "block").mapInPandas(tidy(search), "file string, block int, ends array<long>"), "token-blocks")
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    state = found.select("file", "block", F.size("ends").alias("n"), F.try_element_at("ends", F.lit(-1)).alias("last"))
    carried = state.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("seen"), F.coalesce(F.last("last", True).over(before), F.lit(-1)).alias("previous"))
    both = found.join(carried, ["file", "block"])
    each = F.arrays_zip(F.col("ends").alias("end"), F.concat(F.array("previous"), F.slice("ends", 1, F.greatest(F.size("ends") - 1, F.lit(0)))).alias("previous"))
    rows = both.where(F.size("ends") > 0).select("file", "seen", F.posexplode(each.cast("array<struct<end:long,previous:long>>")).alias("i", "d"))
    return rows.select("file", (F.col("seen") + F.col("i")).alias("nth"), (F.col("d.previous") + 1).alias("start"), (F.col("d.end") - F.col("d.previous") - 1).alias("n_tokens"))


def count_tokens(docs: DataFrame, ranks: str, end_id: int = 50256, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write docs as token files into the shared folder, scan these, and name the documents: key, n_tokens, file_no, start."""
    manifest = write_token_files(docs, new_path(docs.sparkSession, "tokens"), ranks, end_id, key, text)
    counts = scan_token_files(manifest, end_id)
    return manifest.join(counts, ["file", "nth"]).select(F.col("k").alias(key), "n_tokens", F.regexp_extract("file", r"part-(\d+)-", 1).cast("int").alias("file_no"), "start")


def op2_separator_scan(spark, sf_dir):
    import public_tokenizers

    return count_tokens(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
