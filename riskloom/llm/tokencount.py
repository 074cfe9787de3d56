"""Token counts of a sentence-piece model without tokenising documents."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain, islice
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from riskloom.llm.common import filled_id, forget, once, written

#: A pre-token is frequent if it is known to hold this share of all occurrences, so at most 1/share of them are.
FREQUENT_SHARE = 1 / 700_000

#: Longer pre-tokens never count as frequent; together both bound what is broadcast.
FREQUENT_BYTES = 64

#: Distinct pre-tokens a task holds before it hands its counts or its pack on.
HELD = 1_000_000

#: A pack is full with so many documents, or so many rare runs in them; it takes whole batches.
PACK_DOCS = 60_000
PACK_ENTRIES = 500_000

#: Occurrences of pre-tokens for each bucket in which rare ones meet; a task holds the pieces of one bucket at a time.
BUCKET_TOKENS = 2_000_000

#: Letters. Runs of them are cut from all else if no piece of the model holds a letter beside something else.
LETTER = r"[^\W\d_²³¹¼½¾ªº]"
RUN = re.compile(rf" *{LETTER}+|(?:(?!{LETTER}).)+", re.S)

#: A character in no piece, behind which a run is encoded that continues a word.
OUTSIDE = "\ue000"


def pre_tokens(text: str) -> list[str]:
    """Cut a text where no piece of the model can cross: before every run of spaces.

    The model turns spaces into a mark, puts one in front of the text, and has no
    piece in which a mark follows another character. A pre-token is a run
    of marks with what follows; it is returned without its first mark, which the model
    puts back when the pre-token is encoded by itself.
    """
    if not text:
        return []
    parts = text.replace("▁", " ").split(" ")
    if "" not in parts:
        return parts
    found, marks = [], ""
    for part in parts:
        if part:
            found.append(marks + part)
            marks = ""
        else:
            marks += " "
    if marks:
        found.append(marks[1:])
    return found


def _load(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def letters_apart(pieces: list[str]) -> bool:
    """Whether no piece, after its leading marks, holds a letter beside something else: then none crosses the ends of a run of letters."""
    letter = re.compile(LETTER)
    for piece in pieces:
        kinds = {bool(letter.match(c)) for c in piece.lstrip("▁")}
        if len(kinds) > 1 or OUTSIDE in piece or "▁" in piece.lstrip("▁"):
            return False
    return True


def _cutter(model: str) -> Callable[[str], list[str]]:
    """Cuts a pre-token into runs, if the model allows. All runs but the first start with a mark, which no pre-token holds."""

    def allowed() -> bool:
        loaded = _load(model)
        plain = [i for i in range(loaded.get_piece_size()) if not (loaded.is_control(i) or loaded.is_byte(i) or loaded.is_unknown(i))]
        return letters_apart([loaded.id_to_piece(i) for i in plain])

    find = RUN.findall

    def cut(token: str) -> list[str]:
        runs = find(token)
        return [token] if len(runs) < 2 else [runs[0], *["▁" + r for r in runs[1:]]]

    def whole(token: str) -> list[str]:
        return [token]

    return cut if once(f"letters apart:{model}", allowed) else whole


def _pieces(model: str) -> Callable[[list[str]], list[int]]:
    """Counts the pieces of runs."""

    def count(runs: list[str]) -> list[int]:
        encode = once(f"sentencepiece:{model}", lambda: _load(model)).encode
        before = len(encode(OUTSIDE))
        found = encode([OUTSIDE + r[1:] if r[:1] == "▁" else r for r in runs], num_threads=1)
        # The mark alone encodes to nothing by itself, as the model adds none to an empty text.
        return [len(x) - before if r[:1] == "▁" else len(x) if r else 1 for x, r in zip(found, runs, strict=True)]

    return count


def frequent_pieces(texts: DataFrame, model: str, share: float = FREQUENT_SHARE) -> tuple[dict[str, int], int]:
    """Pieces of the frequent runs, and the number of all runs: of all that hold twice the share, and of none that holds less than it.

    A run with twice the share of all occurrences keeps more than one share after the
    parts in which it holds less are left out; so leaving them out of the exchange loses none.
    The pieces are counted in tasks; the driver receives the bounded dictionary only.
    """

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Counts of the runs that hold their share within what a task holds at once, and that total."""
        cut = _cutter(model)

        def heads(held: Counter) -> pd.DataFrame:
            runs: Counter = Counter()
            for token, n in held.items():
                for run in cut(token):
                    runs[run] += n
            total = sum(runs.values())
            often = {r: n for r, n in runs.items() if n >= total * share and len(r.encode()) <= FREQUENT_BYTES}
            return pd.DataFrame({"run": [None, *often], "freq": [total, *often.values()]})

        held: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                held.update(pre_tokens(text))
                if len(held) > HELD:
                    yield heads(held)
                    held = Counter()
        yield heads(held)

    count = _pieces(model)

    def sized(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"run": batch["run"], "n": count(batch["run"].tolist())})

    counted = texts.select("text").mapInPandas(local, "run string, freq long").groupBy("run").agg(F.sum("freq").alias("freq"))
    counted = written(counted)
    total = counted.where("run is null").agg(F.sum("freq")).first()[0] or 0
    often = counted.where(F.col("run").isNotNull() & (F.col("freq") >= F.lit(total * share))).select("run")
    return {r.run: r.n for r in often.mapInPandas(sized, "run string, n long").collect()}, total


def _narrow(numbers: np.ndarray) -> bytes:
    """Numbers from 0 on in the narrowest of three widths, which the first byte tells."""
    width = "<u2" if not len(numbers) or numbers.max() < 1 << 16 else "<u4" if numbers.max() < 1 << 32 else "<u8"
    return width[-1:].encode() + numbers.astype(width).tobytes()


def _wide(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, f"<u{packed[:1].decode()}", offset=1).astype("int64")


class _Numbers(dict):
    """Numbers from 0 on for what is looked up, in the order of its first lookup."""

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        return number


class _Pack:
    """Documents of a task with what is known of them, and the rare runs in them.

    Each different pre-token is cut and looked up once a pack; what it gives is added up for all documents of a batch at once.
    """

    def __init__(self, number: int):
        self.number = number
        self.ids, self.has_ids, self.sizes, self.known = [], [], [], []
        self.names = _Numbers()
        self.name, self.at, self.freq, self.entries = [], [], [], 0
        self.digest = hashlib.blake2b(digest_size=16)
        self.tokens = _Numbers()
        # By pre-token: pieces of its frequent runs, where its rare ones begin in ``rare``, and how many these are.
        self.pieces, self.start, self.rares = (np.empty(0, "int64") for _ in range(3))
        self.rare = np.empty(0, "int64")

    def learn(self, head: dict[str, int], cut: Callable[[str], list[str]]) -> None:
        """Look up the pre-tokens that came since the last time."""
        pieces, rares, rare = [], [], []
        for token in islice(self.tokens, len(self.pieces), None):
            whole = head.get(token)
            if whole is not None:
                pieces.append(whole)
                rares.append(0)
                continue
            known = unknown = 0
            for run in cut(token):
                if (n := head.get(run)) is None:
                    unknown += 1
                    rare.append(self.names[run])
                else:
                    known += n
            pieces.append(known)
            rares.append(unknown)
        count = np.array(rares, "int64")
        self.start = np.concatenate([self.start, len(self.rare) + np.cumsum(count) - count])
        self.pieces, self.rares = np.concatenate([self.pieces, np.array(pieces, "int64")]), np.concatenate([self.rares, count])
        self.rare = np.concatenate([self.rare, np.array(rare, "int64")])

    def add(self, ids: list, has_ids: list[bool], texts: list[str], head: dict[str, int], cut: Callable[[str], list[str]]) -> None:
        first = len(self.ids)
        cuts = [pre_tokens(text) for text in texts]
        lengths = np.fromiter(map(len, cuts), "int64", len(cuts))
        tokens = np.fromiter(map(self.tokens.__getitem__, chain.from_iterable(cuts)), "int64", int(lengths.sum()))
        self.learn(head, cut)
        ends = np.cumsum(lengths)
        total = np.concatenate([[0], np.cumsum(self.pieces[tokens])])
        self.known.append(total[ends] - total[ends - lengths])
        among = self.rares[tokens] > 0
        place, freq = np.unique(np.repeat(np.arange(len(cuts)), lengths)[among] * len(self.tokens) + tokens[among], return_counts=True)
        place, token = np.divmod(place, max(len(self.tokens), 1))
        count = self.rares[token]
        within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        self.name.append(self.rare[np.repeat(self.start[token], count) + within])
        self.at.append(np.repeat(place, count) + first)
        self.freq.append(np.repeat(freq, count))
        self.entries += len(within)
        for number, own, text in zip(ids, has_ids, texts, strict=True):
            data = text.encode("utf-8", "surrogatepass")
            self.digest.update(f"{own}:{number}:{len(data)}:".encode("utf-8", "surrogatepass"))
            self.digest.update(data)
            self.sizes.append(len(data))
        self.ids += ids
        self.has_ids += has_ids

    def rows(self, buckets: int) -> pd.DataFrame:
        """One row a bucket with its runs, and one with the documents."""
        task = TaskContext.get()
        key = f"{task.partitionId() if task else 0}:{self.number}:".encode() + self.digest.digest()
        names = list(self.names)
        bucket = np.fromiter((crc32(n.encode("utf-8", "surrogatepass")) % buckets for n in names), "int64", len(names))
        by_bucket = np.argsort(bucket, kind="stable")
        place = np.empty(len(names), "int64")
        place[by_bucket] = np.arange(len(names))
        entry = place[np.concatenate(self.name)]
        order = np.argsort(entry, kind="stable")
        entry, at, freq = entry[order], np.concatenate(self.at)[order], np.concatenate(self.freq)[order]
        found, starts = np.unique(bucket[by_bucket], return_index=True)
        ends = np.append(starts[1:], len(names))[: len(starts)]
        rows = []
        for b, i, j in zip(found.tolist(), starts.tolist(), ends.tolist(), strict=True):
            lo, hi = np.searchsorted(entry, [i, j])
            uses = np.bincount(entry[lo:hi] - i, minlength=j - i)
            runs = "▁▁".join(names[k] for k in by_bucket[i:j])
            rows.append((b, key, runs, _narrow(uses), _narrow(at[lo:hi]), _narrow(freq[lo:hi]), 1, None, None, None))
        own = (self.ids, _narrow(np.array(self.sizes, "int64")), np.array(self.has_ids, bool).tobytes())
        rows.append((-1 - crc32(key) % 100_000, key, None, None, None, _narrow(np.concatenate(self.known)), -len(rows), *own))
        return pd.DataFrame(rows, columns=["bucket", "pack", "runs", "uses", "at", "n", "parts", "ids", "sizes", "has_ids"])


def token_counts(
    docs: DataFrame, model: str, id_column: str = "doc_id", text_column: str = "text", share: float = FREQUENT_SHARE, pack_entries: int = PACK_ENTRIES
) -> DataFrame:
    """Tokens of each text: one row per row of ``docs`` with ``doc_id``, ``n_bytes`` and ``n_tokens``.

    Pieces are counted once per distinct pre-token (or run of letters or of other characters in it, where no piece of the
    model joins them), and documents meet these counts by it: the frequent ones, whose number and length are bounded
    whatever the input, through a broadcast dictionary; all others where their per-document frequencies have been brought
    together by bucket. There, none can be a hot key, as each holds less than twice the share. A task packs the rare runs of
    many documents, whose different pre-tokens it looks up once, into one row a bucket, in which a document is its place in the pack; the sums return to the pack's own row,
    which holds the ids. So documents need no identity of their own, and token ids are never kept.

    A pack is named by task, number and a digest of its rows. If ``docs`` gives its rows in another order when a lost task runs
    again, the parts of a pack do not add up, and the query fails instead of returning wrong sums; write such input to a table first.

    NULL counts as empty text: no bytes, no tokens. Repeated rows each get their row, NULL ids too.
    Texts may be of any length. An empty table gives no rows.
    """
    spark = docs.sparkSession
    doc_id, has_id = filled_id(docs, id_column)
    rows = docs.select(doc_id.alias("doc_id"), has_id.alias("has_id"), F.coalesce(docs[text_column], F.lit("")).alias("text"))
    head, total = frequent_pieces(rows, model, share)
    known = spark.sparkContext.broadcast(head)
    buckets = total // BUCKET_TOKENS + 1

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        head, cut = known.value, _cutter(model)
        pack = _Pack(0)
        for batch in batches:
            pack.add(batch["doc_id"].tolist(), batch["has_id"].tolist(), batch["text"].tolist(), head, cut)
            if len(pack.ids) >= PACK_DOCS or pack.entries >= pack_entries or len(pack.tokens) >= HELD:
                yield pack.rows(buckets)
                pack = _Pack(pack.number + 1)
        if pack.ids:
            yield pack.rows(buckets)

    count = _pieces(model)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces: dict[str, int] = {}
        last = None
        for batch in batches:
            found = []
            for bucket, runs, uses, at, n in zip(batch["bucket"], batch["runs"], batch["uses"], batch["at"], batch["n"], strict=True):
                if bucket < 0:
                    found.append((at, n))
                    continue
                if bucket != last:
                    pieces, last = {}, bucket
                names = runs.split("▁▁")
                new = [r for r in names if r not in pieces]
                pieces.update(zip(new, count(new), strict=True))
                each = np.repeat(np.fromiter((pieces[r] for r in names), "int64", len(names)), _wide(uses))
                places, where = np.unique(_wide(at), return_inverse=True)
                order = np.argsort(where, kind="stable")
                total = np.concatenate([[0], np.cumsum((each * _wide(n))[order])])
                ends = np.cumsum(np.bincount(where, minlength=len(places)))
                found.append((_narrow(places), _narrow(np.diff(total[np.concatenate([[0], ends])]))))
            yield batch[["pack", "parts", "ids", "sizes", "has_ids"]].assign(at=[a for a, _ in found], n=[n for _, n in found])

    def gathered(group: pd.DataFrame) -> pd.DataFrame:
        if group["parts"].sum() != 0:
            raise RuntimeError("the input's rows came in another order when a lost task ran again; write the input to a table first")
        own = group[group["parts"] <= 0].iloc[0]
        tokens = _wide(own["n"])
        for at, n in zip(group["at"], group["n"], strict=True):
            if at is not None:
                tokens[_wide(at)] += _wide(n)
        has_id = np.frombuffer(own["has_ids"], bool)
        return pd.DataFrame({"doc_id": list(own["ids"]), "has_id": has_id, "n_bytes": _wide(own["sizes"]), "n_tokens": tokens})

    kind = rows.schema["doc_id"].dataType.simpleString()
    result = f"pack binary, parts long, ids array<{kind}>, sizes binary, has_ids binary, at binary, n binary"
    parts = rows.mapInPandas(packed, f"bucket long, pack binary, runs string, uses binary, at binary, n binary, parts long, ids array<{kind}>, sizes binary, has_ids binary")
    together = parts.repartition(F.col("bucket")).sortWithinPartitions("bucket")
    summed = together.mapInPandas(counted, result).groupBy("pack").applyInPandas(gathered, f"doc_id {kind}, has_id boolean, n_bytes long, n_tokens long")
    return summed.select(F.when(F.col("has_id"), F.col("doc_id")).alias("doc_id"), "n_bytes", "n_tokens")
