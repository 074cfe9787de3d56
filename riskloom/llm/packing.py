"""Pack tokenised documents into training sequences: vector bin packing with a dot-product heuristic."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from riskloom.llm.common import filled_id, forget, once

#: Rows that are packed together in one task; every group leaves at most one badly filled sequence behind.
GROUP_ROWS = 4_000


@dataclass(frozen=True)
class Limits:
    """What a sequence may hold at most."""

    tokens: int = 1024
    segments: int = 256
    loss_tokens: int = 1024


def special_strings(path: str) -> list[str]:
    """The strings of the added tokens of a tokenizer's file."""
    import json

    with open(path, encoding="utf-8") as file:
        return [t["content"] for t in json.load(file).get("added_tokens") or []]


def rank_encoder(path: str):
    """An encoder by merge ranks for the same byte-level vocabulary, or None if the file is not of that kind.

    It encodes texts in a fraction of the time. Ids are ranks where tokens are numbered in
    the order of their merges.
    """
    import json

    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, cut = spec["model"], spec["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and not model["end_of_word_suffix"] and not spec["normalizer"]
    if not plain or cut.get("type") != "ByteLevel" or not cut.get("use_regex") or cut.get("add_prefix_space"):
        return None
    made = [a + b for a, b in (m.split(" ") if isinstance(m, str) else m for m in model["merges"])]
    if [model["vocab"][x] for x in made] != list(range(256, 256 + len(made))):
        return None
    # The file writes printable bytes as their Latin-1 character and the others, in order, from 256 on.
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [x for x in range(256) if x not in set(printable)]
    byte_of = {chr(x): x for x in printable} | {chr(256 + i): x for i, x in enumerate(others)}
    added = {t["content"] for t in spec["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in k): v for k, v in model["vocab"].items() if k not in added}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoder(path: str):
    """``encode(text) -> bytes`` of little-endian unsigned 32-bit ids, for a byte-level BPE file.

    Whole texts go through the encoder by ranks; texts that hold a special token's string, and files of another kind, go through the
    library that the file belongs to, which is loaded for the first of them. Nothing is remembered between texts, so a worker's memory does not grow with what it has read.
    """

    def load():
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        return Tokenizer.from_file(path)

    forget()
    by_rank = once(f"ranks:{path}", lambda: rank_encoder(path))
    specials = once(f"specials:{path}", lambda: special_strings(path)) if by_rank else []

    def encode(text: str) -> bytes:
        if by_rank and not any(s in text for s in specials):
            found = by_rank.encode_ordinary(text)
        else:
            found = once(f"tokenizer:{path}", load).encode(text, add_special_tokens=False).ids
        return np.asarray(found, dtype="<u4").tobytes()

    return encode


def _tokenised(path: str, end_id: int):
    """Per document: its ids, how many there are, and a number that tells equal documents of a task apart."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path)
        end = int(end_id).to_bytes(4, "little")
        seen: Counter = Counter()
        for batch in batches:
            out = []
            for doc_id, has_id, text in zip(batch["doc_id"], batch["has_id"], batch["text"], strict=True):
                ids = encode(text) + end
                mark = zlib.crc32(ids)
                # Equal rows are told apart by their number, so that any count of them spreads over groups.
                key = (doc_id, has_id, mark)
                seen[key] += 1
                out.append((ids, len(ids) // 4, mark, seen[key]))
                if len(seen) > 200_000:
                    seen = Counter({k: v for k, v in seen.items() if v > 1})
            frame = batch.drop(columns="text")
            frame[["ids", "doc_tokens", "mark", "copy"]] = pd.DataFrame(out, columns=["ids", "doc_tokens", "mark", "copy"], index=frame.index)
            yield frame

    return run


def fill(demands: np.ndarray) -> list[list[int]]:
    """Assign items to bins of unit capacity in every dimension.

    One bin is open at a time. Of the items that still fit, it takes the one
    whose demand has the largest dot product with the room left, each
    dimension weighted by its total demand: items that use what is plentiful in the
    bin and scarce overall go first. Items of equal demand are interchangeable
    and kept as one type; ties go to the first type. Demands must not exceed 1.
    """
    if not len(demands):
        return []
    types, inverse = np.unique(demands, axis=0, return_inverse=True)
    waiting = defaultdict(list)
    for item, kind in enumerate(inverse.ravel()):
        waiting[kind].append(item)
    for items in waiting.values():
        items.reverse()
    weight = demands.sum(axis=0)
    left = np.array([len(waiting[k]) for k in range(len(types))])
    bins: list[list[int]] = []
    while left.any():
        room, content = np.ones(types.shape[1]), []
        while True:
            fits = (left > 0) & (types <= room + 1e-9).all(axis=1)
            if not fits.any():
                break
            kind = int(np.argmax(np.where(fits, types @ (weight * room), -1.0)))
            content.append(waiting[kind].pop())
            left[kind] -= 1
            room = room - types[kind]
        bins.append(content)
    return bins


def pack(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text",
         limits: Limits = Limits(), end_id: int = 0, loss_share: Column | None = None) -> DataFrame:
    """Cut documents into pieces and place the pieces in sequences.

    Returns per piece ``doc_id``, ``start`` and ``length`` (ids of the document before it and in
    it), ``ids`` (little-endian unsigned 32-bit, 4 bytes each), ``doc_tokens``, ``loss_tokens``, ``sequence_id`` and ``offset``.
    The pieces of a sequence in the order of their offsets are its ids. A document's ids are
    those of its text with ``end_id`` after them. Pieces as long as a sequence
    fill one each. What is left of a document, an example, stays whole and is packed under
    all ``limits`` at once. Every token but a piece's first bears loss, or, with ``loss_share`` (a column of ``docs``, 0 to 1, NULL as 1), that
    share of them, rounded up.

    NULL is empty text; an empty text is one piece with the end id alone. Repeated rows are
    packed once each; long texts become many pieces. An empty table gives no rows.

    Ids are exchanged once, to the group that packs them. Groups come from a hash of
    content and copy number, so their size does not depend on any key.
    """
    size = limits.tokens if loss_share is not None else min(limits.tokens, limits.loss_tokens + 1)
    groups = max(1, -(-docs.count() // GROUP_ROWS))
    kind = docs.schema[id_column].dataType.simpleString()
    doc_id, has_id = filled_id(docs, id_column)
    share = F.lit(1.0) if loss_share is None else F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(loss_share.cast("double"), F.lit(1.0))))
    texts = docs.select(
        doc_id.alias("doc_id"), has_id.alias("has_id"), share.alias("share"), F.coalesce(docs[text_column], F.lit("")).alias("text")
    )
    encoded = texts.mapInPandas(
        _tokenised(tokenizer, end_id), f"doc_id {kind}, has_id boolean, share double, ids binary, doc_tokens long, mark long, copy long"
    )
    grouped = encoded.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "has_id", "doc_tokens", "mark", "copy"), F.lit(groups)))

    def place(group: pd.DataFrame) -> pd.DataFrame:
        forget(objects=True)  # the vocabulary, which the tasks before have loaded
        group = group.sort_values(["doc_tokens", "doc_id", "has_id", "mark", "copy"], kind="stable").reset_index(drop=True)
        number = int(group["pack_group"].iloc[0])
        total, ids = group["doc_tokens"].to_numpy(dtype="int64"), group["ids"].tolist()
        bearing = lambda n, i: np.ceil((n - 1) * group["share"].to_numpy()[i] - 1e-9).astype("int64")
        # Pieces (document, start, length) that no limit but the number of tokens concerns, and those to be packed.
        cuts = [(i, k, min(size, int(n) - k)) for i, n in enumerate(total) for k in range(0, int(n), size)]
        at, start, length = (np.array(x, dtype="int64") for x in zip(*cuts, strict=True))
        loss = bearing(length, at)
        # A full piece whose loss is beyond the limit is halved until each part keeps to it.
        while (over := (loss > limits.loss_tokens) & (length > 1)).any():
            half = length[over] // 2
            at, start = np.append(at, at[over]), np.append(start, start[over] + half)
            length = np.append(length, length[over] - half)
            length[: len(over)][over] = half
            loss = bearing(length, at)
        whole = length == limits.tokens
        rows, next_bin = [], 0
        for i in np.flatnonzero(whole):
            rows.append((i, next_bin, 0))
            next_bin += 1
        rest = np.flatnonzero(~whole)
        demands = np.column_stack(
            [length[rest] / limits.tokens, np.full(len(rest), 1 / limits.segments), loss[rest] / max(1, limits.loss_tokens)]
        )
        for content in fill(demands):
            offset = 0
            for i in rest[content]:
                rows.append((i, next_bin, offset))
                offset += int(length[i])
            next_bin += 1
        piece, bin_of, offset = (np.array(x, dtype="int64") for x in zip(*rows, strict=True))
        own = group[["doc_id", "has_id"]].iloc[at[piece]].reset_index(drop=True)
        own["start"], own["length"] = start[piece], length[piece]
        own["ids"] = [ids[at[i]][4 * start[i] : 4 * (start[i] + length[i])] for i in piece]
        own["doc_tokens"], own["loss_tokens"] = total[at[piece]], loss[piece]
        own["sequence_id"], own["offset"] = number + groups * bin_of, offset
        return own

    columns = "start long, length long, ids binary, doc_tokens long, loss_tokens long, sequence_id long, offset long"
    placed = grouped.groupBy("pack_group").applyInPandas(place, f"doc_id {kind}, has_id boolean, {columns}")
    return placed.withColumn("doc_id", F.when(F.col("has_id"), F.col("doc_id"))).drop("has_id")
