"""Where results go: texts, manifests, split lists, reports, model cards."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_texts(docs: DataFrame, path: str) -> None:
    """(stem, text) as parquet; what is there already stays and only new stems are added."""
    spark = docs.sparkSession
    try:
        have = spark.read.parquet(path).select("stem")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
            raise
        have = None
    new = docs if have is None else docs.join(have, "stem", "left_anti")
    new.write.mode("append").parquet(path)


def write_manifest(rows: DataFrame, path: str, name: str = "filename") -> None:
    """One CSV file with a header, sorted: a manifest is small next to the texts."""
    rows.orderBy(name).coalesce(1).write.mode("overwrite").csv(path, header=True)


def append_manifest(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").csv(path, header=True)


def write_split(parts: DataFrame, path: str, key: str, stats: DataFrame, seed: int, fraction: float) -> None:
    """Lists of keys by split, and the counts as JSON."""
    parts.select(F.col(key).cast("string").alias("value"), "split").orderBy("value").write.mode("overwrite").partitionBy("split").text(f"{path}/lists")
    info = stats.agg(F.to_json(F.struct(F.lit(seed).alias("seed"), F.lit(fraction).alias("eval_frac"), F.collect_list(F.struct(*stats.columns)).alias("splits"))).alias("value"))
    info.coalesce(1).write.mode("overwrite").text(f"{path}/stats")


def benchmark_markdown(compression: DataFrame, slices: DataFrame, costs: DataFrame | None = None, canonical: DataFrame | None = None, docs: int = 0, size: int = 0) -> str:
    """The benchmark's report; numbers are rounded here only."""
    out = ["# Tokenizer benchmark", "", f"Held-out set: {docs:,} documents, {size / 1e6:.1f} MB.", "", "| tokenizer | tokens | bytes/token | fewer tokens |", "|---|---|---|---|"]
    out += [f"| {r.tokenizer} | {r.tokens:,} | {r.bytes_per_token:.3f} | {r.rel_pct:+.1f} % |" for r in compression.orderBy("tokenizer").collect()]
    out += ["", "| tokenizer | slice | bytes/token |", "|---|---|---|"]
    out += [f"| {r.tokenizer} | {r.label} | {r.bytes_per_token:.3f} |" for r in slices.orderBy("tokenizer", "label").collect()]
    for title, frame in (("Pattern costs", costs), ("Canonical strings", canonical)):
        if frame is not None:
            out += ["", f"## {title}", "", "| " + " | ".join(frame.columns) + " |", "|" + "---|" * len(frame.columns)]
            out += ["| " + " | ".join(f"{v:.2f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in frame.orderBy(frame.columns[0]).collect()]
    return "\n".join(out) + "\n"


def model_card(meta: dict, compression: dict | None = None) -> tuple[str, str]:
    """Markdown card and JSON configuration of a tokenizer; missing fields show as '?'."""
    size = meta.get("vocab_size")
    lines = [f"# {meta.get('name', '?')}", "", f"Byte-level BPE, vocabulary {size:,}." if isinstance(size, int) else "Byte-level BPE.", f"Chunks: {meta.get('pretokenizer', 'gpt2')}."]
    if meta.get("normalize_unicode"):
        lines.append("Texts must be normalised to plain punctuation first.")
    lines += [f"- {k}: {v}" for k, v in (compression or {}).items()]
    config = {"tokenizer_class": "PreTrainedTokenizerFast", "bos_token": "<|endoftext|>", "eos_token": "<|endoftext|>", "unk_token": "<|endoftext|>", "clean_up_tokenization_spaces": False}
    return "\n".join(lines) + "\n", json.dumps(config, indent=2)
