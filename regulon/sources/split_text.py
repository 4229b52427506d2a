"""Large single files of quoted CSV and of JSON, read in many tasks.

A quoted newline or a nested object makes a record span lines, so where a record
starts depends on all text before it. Spark's readers therefore give such a file to
one task. Here the file is read in pieces between separators, which any split can
find. What a piece does to the reader's state (outside or inside quotes) is a
function of two values, and such functions compose: a piece either keeps the state,
flips it, or sets it. So

1. a task walks its splits in order and gives one row a split: the state after it and
   its totals, for both states that it may start in;
2. these rows are carried over the splits of a file, which gives the start of each;
3. a task walks its splits again, told how they start, and joins the pieces of records.

No text is shuffled for that. Only records cut by the end of a split are gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPLIT = ["file", "block"]


def pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """(file, block, file_size, row, value): the text between separators. ``block`` is the
    start of the split, ``row`` rises inside it."""
    raw = spark.read.option("recursiveFileLookup", True).option("lineSep", separator).text(path)
    return raw.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("file_size"), F.monotonically_increasing_id().alias("row"), "value")


def _composed(then: list[Column], window, state: Column) -> Column:
    """State after the rows of ``window`` begun in ``state``. ``then``: what a row makes of 0 and of 1.

    The last row that sets the state counts, and how many rows since have flipped it.
    """
    sets = then[0] == then[1]
    flips = F.coalesce(F.sum((then[0] > then[1]).cast("int")).over(window), F.lit(0)) % 2
    anchor = F.last(F.when(sets, then[0].bitwiseXOR(F.col("_flips"))), ignorenulls=True).over(window)
    return F.coalesce(anchor, state).bitwiseXOR(flips)


def _starts(splits: DataFrame, names: list[str]) -> DataFrame:
    """(file, block, _start, _end, _base_<name>): the state before and after every split, and the
    totals of the splits of the file before it.

    ``splits`` holds one row a split: ``_t0`` and ``_t1``, the state after the split begun in 0
    and in 1, and ``_total_<name>_0`` and ``_1``, what it adds.
    """
    t = [F.col("_t0"), F.col("_t1")]
    line = Window.partitionBy("file").orderBy("block")  # one row a split
    upto, before = line.rowsBetween(Window.unboundedPreceding, 0), line.rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_flips", F.sum((t[0] > t[1]).cast("int")).over(upto) % 2)
    splits = splits.withColumn("_start", _composed(t, before, F.lit(0)))
    total = {n: F.when(F.col("_start") == 0, F.col(f"_total_{n}_0")).otherwise(F.col(f"_total_{n}_1")) for n in names}
    end = F.when(F.col("_start") == 0, t[0]).otherwise(t[1])
    return splits.select(*SPLIT, "_start", end.alias("_end"), *[F.coalesce(F.sum(total[n]).over(before), F.lit(0)).alias(f"_base_{n}") for n in names])


def _runs() -> Callable[[Iterator], Iterator]:
    """A pass over batches sorted by split: (key, is the split new, its rows of one batch). The key is the first two columns."""

    def runs(batches):
        import numpy as np
        import pyarrow.compute as pc

        key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = [pc.run_end_encode(c).run_ends.to_numpy() for c in (batch.column(0), batch.column(1))]
            ends = np.unique(np.concatenate(ids))
            for begin, end in zip([0, *ends[:-1]], ends):
                lines = batch.slice(begin, end - begin)
                found = (lines.column(0)[0].as_py(), lines.column(1)[0].as_py())
                yield found, found != key, lines
                key = found

    return runs


# ── CSV ──────────────────────────────────────────────────────────────────

def _walk_lines(assemble: bool) -> Callable[[Iterator], Iterator]:
    """A pass over the lines of a task's splits, in order.

    Without ``assemble`` it gives one row a split: what the split does to both states. With it
    the splits' starts are known (``start``, ``number`` and ``offset``), and it gives
    (split, offset, number, record, torn): the lines of each record, joined. ``torn`` are the
    parts of a record that began in an earlier split or goes on in a later one.
    """

    def afters(lines):
        """State (0: outside quotes) after each line begun in 0 and in 1.

        Doubled quotes change nothing. Of the others one inside quotes closes; one
        outside opens at the start of a field, and is a plain character elsewhere. So
        one at the start of a field flips the state, and one elsewhere sets it to 0.
        """
        import numpy as np

        column = lines.column("value")
        ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        text = np.frombuffer(column.buffers()[2] or b"", np.uint8)[: ends[-1]]
        quote = ends[0] + np.flatnonzero(text[ends[0] :] == ord('"'))
        line = np.searchsorted(ends, quote, "right") - 1
        first = np.ones(len(quote), bool)  # of a run of quotes in a line
        first[1:] = (np.diff(quote) > 1) | (np.diff(line) > 0)
        run = np.flatnonzero(first)
        odd = np.diff(np.append(run, len(quote))) % 2 == 1  # one is left when doubled ones are gone
        quote, line = quote[run][odd], line[run][odd]
        flips = (quote == ends[line]) | (text[np.maximum(quote - 1, 0)] == ord(","))
        # flips of a line behind its last quote that sets the state
        rows = np.arange(len(quote))
        upto = np.concatenate(([0], np.cumsum(flips)))
        last = np.full(len(column), -1)
        np.maximum.at(last, line[~flips], rows[~flips])
        bounds = np.searchsorted(line, np.arange(len(column) + 1))
        odd = (upto[bounds[1:]] - upto[np.maximum(bounds[:-1], last + 1)]) % 2
        return odd, np.where(last >= 0, odd, 1 - odd)

    def states(after0, after1, start):
        """State before each line, and after the last."""
        import numpy as np

        rows = np.arange(len(after0))
        sets = after0 == after1
        flips = np.cumsum(after0 > after1) % 2
        last = np.maximum.accumulate(np.where(sets, rows, -1))
        after = np.where(last >= 0, after0[last] ^ flips[last], start) ^ flips
        return np.concatenate(([start], after[:-1])), int(after[-1])

    runs = _runs()

    def numbers(lines, name):
        return lines.column(name).to_numpy(zero_copy_only=False)

    def split_rows(batches):
        import numpy as np
        import pyarrow as pa

        names = ["file", "block", "_t0", "_t1", "_total_starts_0", "_total_starts_1", "_total_offset_0", "_total_offset_1"]
        row = None
        for key, new, lines in runs(batches):
            if new:
                if row:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, row))], schema)
                row = [*key, 0, 1, 0, 0, 0, 0]
            after0, after1 = afters(lines)
            text, size = ~numbers(lines, "blank"), int(numbers(lines, "bytes").sum())
            for s in (0, 1):
                state, row[2 + s] = states(after0, after1, row[2 + s])
                row[4 + s] += int(((state == 0) & text).sum())
                row[6 + s] += size
        if row:
            yield pa.RecordBatch.from_pylist([dict(zip(names, row))], schema)

    def record_rows(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def out(split, offsets, firsts, texts, torn):
            n = len(offsets)
            return pa.RecordBatch.from_arrays([
                pa.array(np.full(n, split), pa.int64()), pa.array(offsets, pa.int64()), pa.array(firsts, pa.int64()), texts,
                pa.array(np.full(n, torn), pa.bool_())], names=["split", "offset", "number", "record", "torn"])

        def part(key, of):  # a record that is not, or not known to be, whole in its lines
            return out(key[0], [of["offset"]], [of["number"]], pa.array([b"\n".join(of["lines"])], pa.binary()), of["torn"])

        at = None  # of the split: state, number of the next record, offset of the next line
        held = None  # the record that is open behind the last line
        was = None
        for key, new, lines in runs(batches):
            if new:
                if held:
                    yield part(was, held | {"torn": held["torn"] or at[0] == 1})
                held, was = None, key
                at = [lines.column(c)[0].as_py() for c in ("start", "number", "offset")]
                if None in at:
                    raise ValueError("the file was split in another way when it was read again")
                if at[0] == 1:
                    held = {"offset": at[2], "number": at[1] - 1, "lines": [], "torn": True}
            after0, after1 = afters(lines)
            state, end = states(after0, after1, at[0])
            size = numbers(lines, "bytes")
            offset = at[2] + np.cumsum(size) - size
            at[0], at[2] = end, at[2] + int(size.sum())
            keep = np.flatnonzero((state == 1) | ~numbers(lines, "blank"))
            if not len(keep):
                continue
            value, state, offset = lines.column("value").take(pa.array(keep)), state[keep], offset[keep]
            begin = np.flatnonzero(state == 0)
            head = int(begin[0]) if len(begin) else len(keep)
            if head:
                held["lines"] += value.slice(0, head).to_pylist()
            if not len(begin):
                continue
            if held:
                yield part(key, held)
                held = None
            number = at[1] + np.arange(len(begin))
            at[1] += len(begin)
            if end == 1:  # the last record goes on
                held = {"offset": int(offset[begin[-1]]), "number": int(number[-1]), "lines": value.slice(int(begin[-1])).to_pylist(), "torn": False}
                bounds, begin, number = begin, begin[:-1], number[:-1]
            else:
                bounds = np.append(begin, len(keep))
            if len(begin):
                groups = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), value)
                yield out(key[0], offset[begin], number, pc.binary_join(groups, b"\n"), False)
        if held:
            yield part(was, held | {"torn": held["torn"] or at[0] == 1})

    if assemble:
        return record_rows
    import pyarrow as pa

    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("_t0", pa.int32()), ("_t1", pa.int32())]
                       + [(f"_total_{n}_{s}", pa.int64()) for n in ("starts", "offset") for s in (0, 1)])
    return split_rows


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, number, record): the records of quoted CSV files, blank lines left out.

    ``offset`` is the byte at which a record starts, ``number`` counts the records of
    a file from 0 (the header). Quotes inside quoted fields are doubled.
    """
    lines = pieces(spark, path, "\n")
    lines = lines.withColumn("blank", F.trim(F.rtrim("value", F.lit("\r"))) == "").withColumn("bytes", (F.octet_length("value") + 1).cast("long")).withColumn(
        "value", F.col("value").cast("binary"))
    sums = ", ".join(f"_total_{n}_{s} long" for n in ("starts", "offset") for s in (0, 1))
    splits = lines.select(*SPLIT, "blank", "bytes", "value").mapInArrow(
        _walk_lines(assemble=False), f"file string, block long, _t0 int, _t1 int, {sums}")
    splits = _starts(splits, ["starts", "offset"])
    # one row a split: it is broadcast, so the lines stay where and in the order in which they are read
    splits = splits.withColumn("split", F.monotonically_increasing_id()).checkpoint(eager=True)

    begun = splits.select(*SPLIT, "split", "_end", F.col("_start").alias("start"), F.col("_base_starts").alias("number"), F.col("_base_offset").alias("offset"))

    def records(begun: DataFrame, how: str) -> DataFrame:
        told = lines.join(F.broadcast(begun), SPLIT, how).select(
            "split", "block", "start", "number", "offset", "blank", "bytes", "value")
        rows = told.mapInArrow(_walk_lines(assemble=True), "split long, offset long, number long, record binary, torn boolean")
        return rows.withColumn("record", F.col("record").cast("string")).join(F.broadcast(begun.select("split", "file")), "split")

    single = records(begun, "left").where(~F.col("torn")).select("file", "offset", "number", "record")
    # a second look at the splits that cut a record
    cut = records(begun.where((F.col("start") == 1) | (F.col("_end") == 1)), "inner").where("torn")
    parts = F.array_sort(F.collect_list(F.struct("offset", "record")))
    spread = cut.groupBy("file", "number").agg(parts.alias("l")).select(
        "file", F.col("l")[0]["offset"].alias("offset"), "number", F.array_join(F.transform("l", lambda x: x["record"]), "\n").alias("record"))
    return single.unionByName(spread).withColumn("record", F.regexp_replace("record", "\r$", ""))


def read_csv(spark: SparkSession, path: str, names: list[str], check_header: bool = False, one_header: bool = False) -> DataFrame:
    """(file, offset, *names): the fields of quoted CSV files by place, all strings; headers left out.

    With ``check_header`` a file whose header has other names fails the job. With
    ``one_header`` the files are parts of one: only the first by name has a header.
    """
    ddl = ", ".join("`{}` string".format(n.replace("`", "``")) for n in names)
    rows = csv_records(spark, path).withColumn("r", F.from_csv("record", F.lit(ddl), {"escape": '"', "multiLine": "true"}))
    header = F.col("number") == 0
    if one_header:
        header &= F.col("file") == rows.agg(F.min("file")).scalar()
    keep = ~header
    if check_header:
        found = F.array(*[F.lower(F.trim(F.col("r").getField(n))) for n in names])
        alike = F.coalesce(found == F.array(*[F.lit(n.lower()) for n in names]), F.lit(False))
        wrong = F.raise_error(F.concat(F.lit(f"CSV header does not conform to the schema: {', '.join(names)} expected, got "), F.col("record")))
        keep = F.when(header, F.when(alike, F.lit(False)).otherwise(wrong.cast("boolean"))).otherwise(F.lit(True))
    return rows.where(keep).select("file", "offset", *[F.col("r").getField(n).alias(n) for n in names])


# ── JSON ─────────────────────────────────────────────────────────────────

ANY = "\u007f"  # stands for a key that is not known yet
JOINS = r"\s*(,\s*[^}\],\s]|[}\]])"  # how a cutting begins behind another
CHUNK_BYTES = 1 << 16  # neighbours of an object that are parsed together: a JSON parser for each is most of the time


def _walk_braces(told: str | None) -> Callable[[Iterator], Iterator]:
    """A pass over the pieces of a task's splits, in order.

    Without ``told`` it gives one row a split: what the split does to both states, its brackets
    and its bytes. Else the splits' starts are known (``start``, ``depth`` and ``offset``), and
    it gives cuttings, without their last brace and with the byte at which they start:
    ``whole`` those that lie in one split and in one object, neighbours together up to some
    size and whether each ``joins`` the one before, ``rest`` the others and what the end of
    a split tells of its file. ``torn`` are the first and the last part of a split.
    """
    runs, chunk, begins = _runs(), CHUNK_BYTES, JOINS.encode()

    def joining(lines, firsts):
        """Whether the cuttings that begin with the pieces ``firsts`` begin with a comma and something behind it."""
        import re

        import numpy as np

        column = lines.column("value")
        ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        text = np.frombuffer(column.buffers()[2] or b"", np.uint8)[: ends[-1]]
        table = np.zeros(256, np.uint8)
        table[list(b" \t\n\x0b\f\r")], table[ord(",")], table[list(b"}]")] = 1, 2, 3
        at = ends[firsts][:, None] + np.arange(16)
        kind = np.where(at < ends[firsts + 1][:, None], table[text[np.minimum(at, max(len(text) - 1, 0))]] if len(text) else 3, 4)  # 4: behind the piece
        comma = np.argmax(kind != 1, axis=1)
        rows = np.arange(len(firsts))
        behind = (kind != 1) & (np.arange(16) > comma[:, None])
        joins = (kind[rows, comma] == 2) & behind.any(axis=1) & (kind[rows, np.argmax(behind, axis=1)] == 0)
        for k in np.flatnonzero(~joins):  # more white space than was looked at, or none that joins
            joins[k] = bool(re.match(begins, column[int(firsts[k])].as_py() + b"}"))
        return joins

    def signs(lines):
        """Of the quotes and brackets: kind (1 quote, 2 opens, 3 closes) and how many quotes are before; where the pieces' own begin; the pieces' lengths."""
        import numpy as np

        column = lines.column("value")
        ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        text = np.frombuffer(column.buffers()[2] or b"", np.uint8)[: ends[-1]]
        table = np.zeros(256, np.uint8)
        table[[ord(c) for c in '"{[]']] = 1, 2, 2, 3
        at = ends[0] + np.flatnonzero(table[text[ends[0] :]])
        piece = np.searchsorted(ends, at, "right") - 1
        behind = np.flatnonzero((at > ends[piece]) & (text[np.maximum(at - 1, 0)] == ord("\\")))
        if len(behind):  # escaped by the last of an odd number of backslashes; an escape never reaches over a brace
            slash = ends[0] + np.flatnonzero(text[ends[0] :] == ord("\\"))
            first = np.ones(len(slash), bool)
            first[1:] = (np.diff(slash) > 1) | (np.diff(np.searchsorted(ends, slash, "right")) > 0)
            begin = np.maximum.accumulate(np.where(first, slash, 0))
            odd = (at[behind] - begin[np.searchsorted(slash, at[behind] - 1)]) % 2 == 1
            at, piece = np.delete(at, behind[odd]), np.delete(piece, behind[odd])
        kind = table[text[at]]
        return kind, np.cumsum(kind == 1) - (kind == 1), np.searchsorted(piece, np.arange(len(column) + 1)), np.diff(ends).astype(np.int64)

    def steps(kind, before, own, state):
        """Brackets that a piece closes, what it and the brace behind it add to the depth, and the state behind it, if the batch begins in ``state``."""
        import numpy as np

        outside = (before + state) % 2 == 0
        upto = [np.concatenate(([0], np.cumsum(x))) for x in (outside & (kind == 2), outside & (kind == 3), kind == 1)]
        up, down = (np.diff(x[own]) for x in upto[:2])
        after = (upto[2][own[1:]] + state) % 2
        return down, up - down - (after == 0), after

    def split_rows(batches):
        import pyarrow as pa

        row = None
        for key, new, lines in runs(batches):
            if new:
                if row:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row))], schema)
                row = [*key, 0, 1, 0, 0, 0, 0]
            kind, before, own, size = signs(lines)
            for s in (0, 1):
                _, step, after = steps(kind, before, own, row[2 + s])
                row[2 + s] = int(after[-1])
                row[4 + s] += int(step.sum())
                row[6 + s] += int(size.sum()) + len(size)
        if row:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row))], schema)

    def cuttings(batches):
        import re

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def part(split, of):  # cut by an end of the split
            return pa.RecordBatch.from_pylist([{"split": split, "torn": True, **of, "text": b"}".join(of["text"])}], schema)

        def verdict(split, of):
            return pa.RecordBatch.from_pylist([{"split": split, **of}], schema)

        at = held = end = was = None
        for key, new, lines in runs(batches):
            if new:
                if was and told == "rest":
                    if held:
                        yield part(was[0], held)
                    yield verdict(was[0], end)
                at = [lines.column(c)[0].as_py() for c in ("start", "depth", "offset")]
                if None in at:
                    raise ValueError("the file was split in another way when it was read again")
                was, first, end = key, True, {"closed": 0}
                held = None  # the cutting that is open behind the last piece
            kind, before, own, size = signs(lines)
            down, step, after = steps(kind, before, own, at[0])
            left = at[1] + np.cumsum(step)
            depth, offset = left - step, at[2] + np.cumsum(size + 1) - size - 1
            at = [int(after[-1]), int(left[-1]), int(offset[-1] + size[-1]) + 1]
            past = offset + size == lines.column("file_size")[0].as_py()  # no brace behind it: the file does not end in one
            low = (depth < 2) | (left < 2) | (depth - down < 2)  # a bracket may have closed the object around the entries, so a new key may have begun
            value = lines.column("value")
            junk = bool(past[-1]) and value[-1].as_py().strip(b" \r\n\t") != b""
            end |= {"closed": end["closed"] + int(((left == 0) & (after == 0) & ~past).sum()), "offset": int(offset[-1]),
                    "depth": int(depth[-1] if past[-1] else left[-1]), "shut": after[-1] == 0, "junk": junk}
            last = np.flatnonzero((after == 0) & (left == 2))
            bounds = np.concatenate(([0], last + 1))
            lows = np.concatenate(([0], np.cumsum(low)))
            over = np.diff(lows[bounds]) > 0
            starts = offset[bounds[:-1]] if len(last) else offset[:0]
            skip = 0
            if len(last) and (held or first):  # goes on from an earlier batch, or from an earlier split
                skip = 1
                begun = held or {"offset": int(starts[0]), "text": [], "low": False}
                begun |= {"text": begun["text"] + value.slice(0, int(bounds[1])).to_pylist(), "low": begun["low"] or bool(over[0]), "ended": True, "past": False}
                if first:
                    if told == "rest":
                        yield part(key[0], begun)
                elif begun["low"] == (told == "rest"):
                    text = b"}".join(begun["text"])
                    yield pa.RecordBatch.from_pylist([{"split": key[0], "torn": False, **begun, "text": text, "joins": bool(re.match(begins, text + b"}"))}], schema)
                held, first = None, False
            wanted = over[skip:] == (told == "rest")
            if wanted.any():
                starts, lengths = starts[skip:], np.diff(bounds[skip:])
                if told == "whole":
                    joins = joining(lines, bounds[skip:-1])
                    head = np.ones(len(wanted), bool)
                    head[1:] = (wanted[1:] != wanted[:-1]) | (starts[1:] // chunk > starts[:-1] // chunk)
                else:
                    head = np.ones(len(wanted), bool)
                head = np.flatnonzero(head)
                keep, n = wanted[head], int(wanted[head].sum())
                pieces_of = value.slice(int(bounds[skip]), int(lengths.sum())).filter(pa.array(np.repeat(wanted, lengths)))
                groups = np.concatenate(([0], np.cumsum(np.add.reduceat(lengths, head)[keep])))
                made = {"split": pa.array(np.full(n, key[0]), pa.int64()), "offset": pa.array(starts[head][keep], pa.int64()),
                        "text": pc.binary_join(pa.ListArray.from_arrays(pa.array(groups, pa.int32()), pieces_of), b"}")}
                if told == "whole":
                    made["joins"] = pa.array(np.logical_and.reduceat(joins, head)[keep])
                else:
                    made |= {c: pa.array(np.full(n, v), pa.bool_()) for c, v in (("low", True), ("ended", True), ("torn", False), ("past", False))}
                yield pa.RecordBatch.from_arrays([made[c] if c in made else pa.nulls(n, schema.field(c).type) for c in schema.names], schema=schema)
            if bounds[-1] < len(value):
                held = held or {"offset": int(offset[bounds[-1]]), "text": [], "low": False, "ended": False}
                held |= {"text": held["text"] + value.slice(int(bounds[-1])).to_pylist(), "low": held["low"] or bool(lows[-1] > lows[bounds[-1]]), "past": bool(past[-1])}
        if was and told == "rest":
            if held:
                yield part(was[0], held)
            yield verdict(was[0], end)

    import pyarrow as pa

    if told is None:
        schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("_t0", pa.int32()), ("_t1", pa.int32())]
                           + [(f"_total_{n}_{s}", pa.int64()) for n in ("depth", "offset") for s in (0, 1)])
        return split_rows
    schema = pa.schema([("split", pa.int64()), ("offset", pa.int64()), ("text", pa.binary())])
    for name, kind in _REST.items() if told == "rest" else (("joins", "boolean"),):
        schema = schema.append(pa.field(name, pa.bool_() if kind == "boolean" else pa.int64()))
    return cuttings


_REST = {"low": "boolean", "ended": "boolean", "torn": "boolean", "past": "boolean", "closed": "long", "depth": "long", "shut": "boolean", "junk": "boolean"}


def json_entries(spark: SparkSession, path: str, field: str, entry: str) -> DataFrame:
    """(file, key, entry): the entries, of type ``entry``, of the top-level object ``field`` of each JSON document.

    A document is a file. It is cut behind every closing brace that leaves two
    brackets open, which is behind each entry of a top-level object, and every cutting
    is parsed as a small document of the same shape. A file that is no whole JSON
    object gives no rows; an equal key comes as often as it is there.

    The files are read four times: for the splits' starts, for the few cuttings that tell
    where ``field`` is, for the files with a cutting that is not sound, and for the entries.
    So no text is stored or shuffled but those few cuttings.
    """
    cut = pieces(spark, path, "}").withColumn("value", F.col("value").cast("binary"))
    sums = ", ".join(f"_total_{n}_{s} long" for n in ("depth", "offset") for s in (0, 1))
    splits = cut.select(*SPLIT, "value").mapInArrow(_walk_braces(None), f"file string, block long, _t0 int, _t1 int, {sums}")
    splits = _starts(splits, ["depth", "offset"]).select(
        *SPLIT, F.col("_start").alias("start"), F.col("_base_depth").alias("depth"), F.col("_base_offset").alias("offset"))
    # one row a split: it is broadcast, so the pieces stay where and in the order in which they are read
    begun = splits.withColumn("split", F.monotonically_increasing_id()).checkpoint(eager=True)
    told = cut.join(F.broadcast(begun), SPLIT, "left").select("split", "block", "start", "depth", "offset", "file_size", "value")
    at = "split long, offset long, text binary"
    rest = told.mapInArrow(_walk_braces("rest"), ", ".join([at, *[f"{c} {t}" for c, t in _REST.items()]]))
    rest = rest.withColumn("text", F.col("text").cast("string")).join(F.broadcast(begun.select("split", "file")), "split").checkpoint(eager=True)

    whole = rest.where(F.col("text").isNull()).groupBy("file").agg(
        F.sum("closed").alias("closed"),  # once, at the end
        F.max_by("depth", "offset").alias("depth"), F.max_by("shut", "offset").alias("shut"), F.max("junk").alias("junk"))
    sound = whole.where((F.col("closed") == 1) & (F.col("depth") == 0) & F.col("shut") & ~F.col("junk")).select("file")

    # parts of a cutting: two a split at most
    parts = rest.where("torn").withColumn("text", F.concat("text", F.when(F.col("past"), "").otherwise("}")))
    order = Window.partitionBy("file").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_nth", F.coalesce(F.sum(F.col("ended").cast("int")).over(order), F.lit(0)))
    spread = parts.groupBy("file", "_nth").agg(
        F.min("offset").alias("number"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", "text"))), lambda x: x["text"]), "").alias("text"),
        F.max("low").alias("low"), F.max("ended").alias("ended")).drop("_nth")
    single = rest.where(~F.col("torn")).select("file", F.col("offset").alias("number"), F.concat("text", F.lit("}")).alias("text"), "low", "ended")
    groups = spread.unionByName(single).checkpoint(eager=True)  # the few cuttings, read by several branches below

    # a cutting becomes a document under a key that stands for the one around it
    rest = F.regexp_replace("text", r"^\s*,", "")

    def under(key: str, start: str, end: str) -> Column:
        tail = F.when(F.col("ended"), end).otherwise("")
        return F.when(F.col("number") == 0, F.concat("text", tail)).otherwise(F.concat(F.lit(f'{{"{key}":{start}'), rest, tail))

    # one that leaves the object around it may come from an array, or end in one
    forms = [under(ANY, start, end) for start in "{[" for end in ("}}", "]}")]
    tried = F.transform(F.array(*forms), lambda doc: F.struct(doc.alias("doc"), F.map_keys(F.from_json(doc, "map<string,string>")).alias("keys")))
    low = groups.where("low").withColumn("read", F.get(F.filter(tried, lambda x: x["keys"].isNotNull()), F.lit(0)))
    low = low.select("file", "number", F.col("read.doc").alias("doc"), F.col("read.keys").alias("keys")).checkpoint(eager=True)
    unjoined = groups.where((F.col("number") > 0) & ~F.col("text").rlike(f"^{JOINS}"))
    # those that begin a new key set what is around the ones behind them
    switches = low.withColumn("key", F.try_element_at("keys", F.lit(-1))).where(F.col("key") != ANY).select("file", "number", "key", "doc")
    order = Window.partitionBy("file").orderBy("number")  # one row a top-level key
    spans = switches.withColumn("next", F.lead("number").over(order)).where(F.col("key") == field)
    spans = spans.select("file", F.col("number").alias("_from"), F.col("next").alias("_next")).checkpoint(eager=True)
    inside = (F.col("number") > F.col("_from")) & (F.col("_next").isNull() | (F.col("number") <= F.col("_next")))
    named = F.concat(F.lit(f'{{"{field}":'), F.substr("doc", F.lit(len(ANY) + 5)))
    docs = groups.where(~F.col("low")).select("file", "number", under(field, "{", "}}").alias("doc"))
    docs = docs.unionByName(low.select("file", "number", named.alias("doc"))).join(spans, "file").where(inside).select("file", "doc")
    docs = docs.unionByName(switches.where(F.col("key") == field).select("file", "doc"))

    def entries(doc: str | Column) -> Column:
        return F.from_json(doc, f"`{field}` map<string,{entry}>")[field]

    parsed = docs.select("file", entries("doc").alias("entries"))
    broken = [low.where(F.col("keys").isNull()), parsed.where(F.col("entries").isNull()), unjoined]
    broken = broken[0].select("file").unionByName(broken[1].select("file")).unionByName(broken[2].select("file"))
    kept = sound.join(broken.distinct(), "file", "left_anti").checkpoint(eager=True)  # one row a file

    # the others: neighbours, inside ``field``, are a document
    many = told.mapInArrow(_walk_braces("whole"), f"{at}, joins boolean").select(
        "split", F.col("offset").alias("number"), F.col("text").cast("string").alias("text"), "joins")
    document = F.concat(F.lit(f'{{"{field}":{{'), rest, F.lit("}}}"))
    within = begun.select("split", "file").join(kept, "file").join(spans, "file")
    seen = many.join(F.broadcast(within), (many["split"] == within["split"]) & inside, "left")
    bad = ~F.col("joins") | F.when(F.col("_from").isNotNull(), entries(document).isNull()).otherwise(F.lit(False))
    broken = seen.where(bad).select(many["split"]).distinct().join(begun.select("split", "file"), "split")
    kept = kept.join(broken, "file", "left_anti").checkpoint(eager=True)
    within = begun.select("split", "file").join(kept, "file").join(spans, "file")
    read = many.join(F.broadcast(within), "split").where(inside).select("file", entries(document).alias("entries"))
    parsed = parsed.join(F.broadcast(kept), "file", "left_semi").unionByName(read)
    # with the plain form, the optimizer would parse once more to leave out what is empty
    return parsed.select("file", F.explode_outer("entries").alias("key", "entry")).where(F.col("key").isNotNull())
