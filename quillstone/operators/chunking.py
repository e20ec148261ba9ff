"""Heading-aware chunking of documents with overlap."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.config import ChunkConfig

HEADING = re.compile(r"#{1,4}\s+(.*)", re.S)
CHUNKS = "key string, doc_id string, seq int, heading string, text string"


def blocks(body: str) -> list[tuple[str | None, str | None]]:
    """(heading, None) and (None, paragraph) in order; four hashes at most make a heading, headings without text go."""
    out: list = []
    run: list[str] = []
    for line in [*re.split(r"\r?\n", body), ""]:
        title = HEADING.match(line)
        if (title or not line.strip()) and run:
            out.append((None, "\n".join(run)))
            run = []
        if title:
            if title[1].strip():
                out.append((title[1].strip(), None))
        elif line.strip():
            run.append(line)
    return out


def pieces(text: str, target: int) -> list[str]:
    """A paragraph above the target, split at lines, and lines above it cut hard."""
    if len(text) <= target:
        return [text]
    out, held = [], ""
    for line in text.split("\n"):
        if held and len(held) + len(line) + 1 > target:
            out.append(held)
            held = ""
        whole = (len(line) - 1) // target if len(line) > target else 0
        out += [line[k * target : (k + 1) * target] for k in range(whole)]
        rest = line[whole * target :]
        held = f"{held}\n{rest}" if held else rest
    return out + [held] if held else out


def chunk_text(title: str | None, body: str | None, cfg: ChunkConfig = ChunkConfig()) -> list[tuple[str | None, str]]:
    """(heading, text) of each chunk.

    Paragraph pieces gather until the next would pass the target and at least min_chars are held; the next chunk then begins with
    the last overlap_chars of the one before. A heading ends a chunk and the overlap. A last chunk below min_chars joins the one
    before it, across headings too. An overlap of 0 means none.
    """
    out: list[list] = []
    held, heading = "", title
    for name, paragraph in [*blocks(body or ""), (title, None)]:
        if name is not None or paragraph is None:
            if held.strip():
                out.append([heading, held.strip()])
            held, heading = "", name
            continue
        for piece in pieces(paragraph, cfg.target_chars):
            if len(held) + len(piece) > cfg.target_chars and len(held) >= cfg.min_chars:
                if text := held.strip():
                    out.append([heading, text])
                    tail = text[-cfg.overlap_chars :] if cfg.overlap_chars > 0 else ""
                    held = f"{tail}\n" if tail else ""
            held += f"\n\n{piece}" if held else piece
    if len(out) > 1 and len(out[-1][1]) < cfg.min_chars:
        out[-2][1] += "\n\n" + out.pop()[1]
    return [(h, t) for h, t in out]


def chunk(docs: DataFrame, cfg: ChunkConfig = ChunkConfig(), id_col="doc_id", title_col="title", body_col="body") -> DataFrame:
    """The chunks of all documents: key `doc#seq`, doc_id, seq, heading, text. Null and blank bodies have none."""

    def run(batches):
        for pdf in batches:
            rows = [
                (f"{doc}#{k}", doc, k, heading, text)
                for doc, title, body in zip(pdf["d"], pdf["t"], pdf["b"], strict=True)
                for k, (heading, text) in enumerate(chunk_text(title, body, cfg))
            ]
            yield pd.DataFrame(rows, columns=["key", "doc_id", "seq", "heading", "text"])

    return docs.select(F.col(id_col).cast("string").alias("d"), F.col(title_col).alias("t"), F.col(body_col).alias("b")).mapInPandas(run, CHUNKS)
