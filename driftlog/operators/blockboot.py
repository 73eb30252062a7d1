"""Prompt-cluster bootstrap of one pair in many tasks.

Prompts are numbered by pair in the order of their ids and cut into leaves of ``LEAF``. A replicate draws as
many prompts as the pair has, with replacement. How many of its draws fall to a leaf comes from a tree over the leaves: at
each node the draws of all replicates are split by binomials, whose generator is keyed by the pair's seed and the node, so
every block of leaves finds its counts by itself, walking down from the root, and all blocks agree. Within a
leaf the draws are positions from hashes of (seed, leaf, replicate, draw).

With ``leaf=None`` a pair of any size is one leaf, which plain SQL can repeat; with ``digests`` its draws come from
the MD5 of (pair, replicate, draw), as in ``bootstrap.portable``. Such a leaf is cut into blocks of ``BLOCK`` prompts. Each
block makes all the pair's draws and keeps those of its own prompts, so time grows with the number of a pair's blocks.

Sums over what is drawn are kept as integers by exponent, in four parts of 22 bits, so they are exact
and meet by plain sums: the result is the same for any number of blocks, tasks and partitions, and each estimate is
rounded once. Weights are taken relative to the pair's greatest before they are summed; below 2^-1074 of it they are 0.

Variants are those of ``bootstrap``: ``paired``, one draw for both estimators, where a replicate that is not finite
still counts for the reference; unpaired, a draw for each, where such a replicate counts for neither.
NULL ``log_is`` is a weight of 0; NaN and infinite ones make the replicates that draw them not finite.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlog.functions.numeric import LOG_GREATEST, finite
from driftlog.operators.overlap import PAIR
from driftlog.operators.selection import numbered, on_keys
from driftlog.sources.scratch import Scratch

LEAF = 1024
#: Prompts of a task where a leaf is as large as its pair.
BLOCK = 1 << 18
#: Draws made at once, and counts of (replicate, prompt) held at once.
DRAWS, CELLS = 1 << 20, 1 << 18
#: Exponents of a bin, bits of a part and parts of an integer: 53 bits of a double and up to 31 of shift.
BIN, PART, PARTS = 32, 22, 4


def _digests():
    """The first 32 bits of the MD5 of ``prefix``, ``replicate|`` and ``draw`` in decimal, for whole arrays of draws."""
    import math

    tile = 1 << 16  # small enough for the cache, large beside the cost of a call
    turns = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
    sines = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
    start = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)

    def word(np, fixed, changing, n):
        """``fixed``: the message's bytes, 0 where one changes; ``changing``: arrays by word, to be added."""
        tail = fixed + b"\x80" + bytes(-(len(fixed) + 9) % 64) + (8 * len(fixed)).to_bytes(8, "little")
        mask, first = 0xFFFFFFFF, min(changing)
        base, whole = list(start), False  # numbers, then arrays
        number = [np.array(i, np.uint32) for i in range(32)]  # calls take arrays quicker than numbers
        add, both, either, other, opposite, left, right = np.add, np.bitwise_and, np.bitwise_or, np.bitwise_xor, np.invert, np.left_shift, np.right_shift
        f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
        for block in range(0, len(tail), 64):
            last = block + 64 == len(tail)
            a, b, c, d = [x.copy() for x in base] if whole else base
            for i in range(61 if last else 64):  # the first word is whole after step 60
                kind = i // 16
                k = (i, 5 * i + 1, 3 * i + 5, 7 * i)[kind] % 16
                at = block + 4 * k
                constant = (sines[i] + int.from_bytes(tail[at : at + 4], "little")) & mask
                turn = turns[kind][i % 4]
                if not whole and kind == 0 and at // 4 < first:  # the same for all draws so far
                    x = (a + (d ^ (b & (c ^ d))) + constant) & mask
                    a, b, c, d = d, (b + ((x << turn | x >> (32 - turn)) & mask)) & mask, b, c
                    continue
                if not whole:
                    a, b, c, d = (np.full(n, x, np.uint32) for x in (a, b, c, d))
                    whole = True
                if kind == 0:
                    other(c, d, f)
                    both(f, b, f)
                    other(f, d, f)
                elif kind == 1:
                    other(b, c, f)
                    both(f, d, f)
                    other(f, c, f)
                elif kind == 2:
                    other(b, c, f)
                    other(f, d, f)
                else:
                    opposite(d, f)
                    either(f, b, f)
                    other(f, c, f)
                add(a, f, a)
                add(a, np.array(constant, np.uint32), a)
                if at // 4 in changing:
                    add(a, changing[at // 4], a)
                right(a, number[32 - turn], t)
                left(a, number[turn], a)
                either(a, t, a)
                add(a, b, a)
                a, b, c, d = d, a, b, c
            if last:
                return (np.asarray(base[0], np.uint32) + b).byteswap()
            if whole:
                base = [np.asarray(x, np.uint32) + y for x, y in zip(base, (a, b, c, d), strict=True)]
            else:
                base = [(x + y) & mask for x, y in zip(base, (a, b, c, d), strict=True)]

    def spans(lo, hi):
        """Ranges of numbers with equally many digits."""
        while lo < hi:
            digits = len(str(lo))
            yield lo, min(hi, 10**digits), digits
            lo = 10**digits

    def digits_by_word(np, x, digits, end):
        """The decimal digits of numbers that end before a byte of the message, to be added to its words."""
        words = {}
        for k in range(1, digits + 1):
            rest = x // np.uint32(10)
            digit, x, at = x - rest * np.uint32(10), rest, end - k
            words[at // 4] = words.get(at // 4, np.uint32(0)) + ((digit + np.uint32(48)) << np.uint32(at % 4 * 8))
        return words

    def run(np, prefix, replicates, draws):
        """By replicate and draw, of two ranges."""
        out = np.empty((replicates[1] - replicates[0], draws[1] - draws[0]), np.uint32)
        for r0, r1, r_digits in spans(*replicates):
            for i0, i1, i_digits in spans(*draws):
                end = len(prefix) + r_digits
                wide = min(i1 - i0, tile)
                tall = max(1, tile // wide)
                for i in range(i0, i1, wide):
                    columns = digits_by_word(np, np.arange(i, min(i + wide, i1), dtype=np.uint32), i_digits, end + 1 + i_digits)
                    n = min(wide, i1 - i)
                    for r in range(r0, r1, tall):
                        m = min(tall, r1 - r)
                        if m == 1:  # the replicate's digits are the same for all draws
                            changing, fixed = columns, prefix + str(r).encode() + b"|" + bytes(i_digits)
                        else:
                            changing, fixed = {w: np.tile(v, m) for w, v in columns.items()}, prefix + bytes(r_digits) + b"|" + bytes(i_digits)
                            for w, v in digits_by_word(np, np.arange(r, r + m, dtype=np.uint32), r_digits, end).items():
                                v = np.repeat(v, n)
                                changing[w] = changing[w] + v if w in changing else v
                        at = out[r - replicates[0] : r - replicates[0] + m, i - draws[0] : i - draws[0] + n]
                        at[:] = word(np, fixed, changing, m * n).reshape(m, n)
        return out

    return run


def _sampler(reps: int, streams: list[str], leaf: int | None, digests: bool, keys: list[str], schema_names: list[str]):
    """The function of a block, free of this module so that workers need not have it."""
    bin_width, part_bits, n_parts, most_draws, most_cells, one_leaf = BIN, PART, PARTS, DRAWS, CELLS, leaf is None
    digest = _digests()
    used = [(0, 1, 2)] if len(streams) == 1 else [(0, 2), (1, 2)]

    def run(table):
        import numpy as np
        import pyarrow as pa

        def mixed(h):
            h = h ^ (h >> np.uint32(16))
            h = h * np.uint32(0x85EBCA6B)
            h = h ^ (h >> np.uint32(13))
            h = h * np.uint32(0xC2B2AE35)
            return h ^ (h >> np.uint32(16))

        def limbs(x):
            """Bin, and parts by value, of doubles that are finite and not negative."""
            bits = x.view(np.int64)
            e = np.maximum(bits >> 52, 1)
            m = (bits & (2**52 - 1)) + np.where(bits >> 52 > 0, 2**52, 0)
            which, shift = e // bin_width, e % bin_width
            low, high = (m & (2**26 - 1)) << shift, (m >> 26) << shift  # below 2^58
            out, carry = np.zeros((n_parts, len(x))), np.zeros(len(x), np.int64)
            mask = (1 << part_bits) - 1
            # the integer is high * 2^26 + low: part by part from below
            whole_low = low + ((high & ((1 << 18) - 1)) << 26)  # 26 + 18 = 44 bits, two parts; below 2^59
            for k in range(2):
                out[k] = (whole_low >> (part_bits * k)) & mask
            carry = whole_low >> (2 * part_bits)
            rest = (high >> 18) + carry
            out[2], out[3] = rest & mask, rest >> part_bits
            return which, out

        table = table.sort_by("_rank")
        n = table.column("_n")[0].as_py()
        leaf_size = n if one_leaf else leaf
        seeds = [table.column(f"_seed{i}")[0].as_py() for i in range(len(streams))]
        key = [table.column(k)[0].as_py() for k in keys]
        rank = table.column("_rank").to_numpy()
        columns = [np.ascontiguousarray(table.column(c).to_numpy().astype(np.float64)) for c in ("_weight", "pwis", "prompt_accuracy")]
        bad = [~np.isfinite(c) for c in columns]
        values = [limbs(np.where(b, 0.0, np.abs(c))) for c, b in zip(columns, bad, strict=True)]
        signs = [np.where(c < 0, -1.0, 1.0) for c in columns]
        begin, end = int(rank[0]), int(rank[-1]) + 1  # a block's ranks follow each other
        first, last = begin // leaf_size, (end - 1) // leaf_size
        leaves = -(-n // leaf_size)
        sums: dict[tuple[int, int, int], np.ndarray] = {}  # by (stream, column, bin): replicates by parts

        def held(stream, lo, hi):
            """What to add up over the prompts from lo to hi: (column, bin, part), and a row for each prompt."""
            names, made = [], []
            for c in used[stream]:
                which, parts = values[c][0][lo - begin : hi - begin], values[c][1][:, lo - begin : hi - begin] * signs[c][lo - begin : hi - begin]
                for w in np.unique(which[(parts != 0).any(axis=0)]).tolist():
                    for p, part in enumerate(np.where(which == w, parts, 0.0)):
                        if part.any():
                            names.append((c, w, p))
                            made.append(part)
                if bad[c][lo - begin : hi - begin].any():
                    names.append((c, -1, 0))
                    made.append(bad[c][lo - begin : hi - begin].astype(np.float64))
            return names, np.array(made).reshape(len(made), hi - lo).T

        def add(stream, number, counts):
            lo = number * leaf_size
            size = min(leaf_size, n - lo)
            low, high = max(lo, begin), min(lo + size, end)
            width = high - low
            names, rows = held(stream, low, high)
            base = mixed(np.array([(seeds[stream] + number * 0x9E3779B1) & 0xFFFFFFFF], np.uint32)) if not digests else None
            most = max(int(counts.max()), 1)
            some = max(1, min(256, most_cells // width, most_draws // most))
            for r0 in range(0, reps, some):
                r1 = min(r0 + some, reps)
                drawn = np.zeros((r1 - r0) * width, np.int64)
                for i0 in range(0, most, most_draws):
                    if digests:  # a replicate's draws are as many as the pair's prompts
                        position = digest(np, seeds[stream].encode(), (r0, r1), (i0, min(i0 + most_draws, most)))
                        position -= position // np.uint32(n) * np.uint32(n)
                        for r, at in enumerate(position):
                            if width < size:
                                at = at[(at >= low - lo) & (at < high - lo)] - np.uint32(low - lo)
                            drawn[r * width : (r + 1) * width] += np.bincount(at, minlength=width)
                        continue
                    here = np.clip(counts[r0:r1] - i0, 0, most_draws)
                    of = np.repeat(np.arange(r1 - r0), here)
                    r = np.arange(r0, r1, dtype=np.uint32)
                    a, b = (mixed(base ^ (r * np.uint32(2) + np.uint32(k)) * np.uint32(0x9E3779B1)) for k in (0, 1))
                    i = (np.arange(len(of)) - np.repeat(np.cumsum(here) - here, here) + i0).astype(np.uint32)
                    draw = mixed(mixed(a[of] ^ i) + b[of])
                    position = ((draw.astype(np.uint64) * np.uint64(size)) >> np.uint64(32)).astype(np.int64)
                    at = position - (low - lo)
                    if width < size:
                        own = (at >= 0) & (at < width)
                        of, at = of[own], at[own]
                    drawn += np.bincount(of * width + at, minlength=len(drawn))
                got = (drawn.reshape(r1 - r0, width).astype(np.float64) @ rows).astype(np.int64)  # exact: below 2^53
                for j, (c, w, p) in enumerate(names):
                    sums.setdefault((stream, c, w), np.zeros((reps, n_parts), np.int64))[r0:r1, p] += got[:, j]

        def walk(stream, lo, hi, counts):
            if hi <= first or lo > last:
                return
            if hi - lo == 1:
                return add(stream, lo, counts)
            middle = (lo + hi) // 2
            left, right = (middle - lo) * leaf_size, min(hi * leaf_size, n) - middle * leaf_size
            random = np.random.Generator(np.random.Philox(key=[seeds[stream] & 0xFFFFFFFF, (lo << 32) | hi]))
            taken = random.binomial(counts, left / (left + right))
            walk(stream, lo, middle, taken)
            walk(stream, middle, hi, counts - taken)

        for stream in range(len(streams)):
            walk(stream, 0, leaves, np.full(reps, n, np.int64))
        rows = [(s, c, w, r, *parts) for (s, c, w), total in sums.items() for r, parts in enumerate(total.tolist()) if any(parts)]
        made = [pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else [[]] * (4 + n_parts))]
        kept = [pa.array([k] * len(rows), table.schema.field(name).type) for k, name in zip(key, keys, strict=True)]
        return pa.Table.from_arrays([*kept, *made], schema_names)

    return run


def _total(bins: list[dict], names: list[str], bin_width: int, part_bits: int) -> float | None:
    """The double nearest to the integers' sum; None where what is not finite was drawn."""
    whole = 0
    for b in bins:
        if b["bin"] < 0:
            return None
        whole += sum(b[p] << (part_bits * k) for k, p in enumerate(names)) << (bin_width * b["bin"])
    return whole / (1 << 1075)  # a double is its integer times 2^(exponent - 1075)


def replicates(matched: DataFrame, reps: int, scratch: Scratch, pair: list[str] = PAIR, paired: bool = True, leaves: int = 32, leaf: int | None = LEAF, digests: bool = False, block: int | None = None) -> DataFrame:
    """``(pair, estimator, replicate, ope_estimate, online_reference, signed_error, absolute_error, estimator_status)``.

    ``leaves``: how many leaves a task takes, or, where ``leaf`` is None, ``block``: how many prompts (``BLOCK``); the result does not
    depend on them. Runs jobs, as ``numbered`` does.
    """
    if digests and leaf is not None:
        raise ValueError("digests number the draws of whole pairs: leaf must be None")
    streams = [""] if paired else ["is", "prompt_wis"]
    prompts = scratch(matched.select(*pair, "prompt_id", "pwis", "log_is", "prompt_accuracy"), "prompts")
    tops = scratch(prompts.groupBy(*pair).agg(F.max(finite(F.col("log_is"))).alias("_top"), F.count(F.lit(1)).alias("n_prompts")), "tops")
    rows = on_keys(numbered(prompts, pair, ["prompt_id"], scratch), tops.drop("n_prompts"), pair)
    block = (block or BLOCK) if leaf is None else leaf * leaves
    if digests:
        name = F.concat_ws("-", *(F.col(c).cast("string") for c in pair))
        seeds = {f"_seed{i}": F.when(F.col("_rank") % block == 0, F.concat(name, F.lit(f"|{s}|" if s else "|"))) for i, s in enumerate(streams)}
    else:
        name = F.concat_ws("-", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in pair))
        seeds = {f"_seed{i}": F.conv(F.substring(F.md5(F.concat_ws("|", name, F.lit(s))), 1, 8), 16, 10).cast("bigint") for i, s in enumerate(streams)}
    bound = F.lit(float("inf") if paired or not digests else LOG_GREATEST)  # what is averaged outside logarithms must be a double itself
    heavy = F.when(F.isnan("log_is") | (F.col("log_is") == float("inf")) | (F.col("log_is") > bound), F.lit(float("nan"))).otherwise(F.exp(F.col("log_is") - F.col("_top")))
    rows = rows.withColumns({"_weight": F.coalesce(heavy, F.lit(0.0)), "_block": F.floor(F.col("_rank") / block).cast("bigint"), **seeds})
    parts = [f"p{k}" for k in range(PARTS)]
    names = [*pair, "stream", "column", "bin", "replicate", *parts]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in matched.select(*pair).schema) + "".join(f", `{c}` bigint" for c in names[len(pair) :])
    rows = rows.select(*pair, "_block", "_rank", "_n", "_weight", F.coalesce("pwis", F.lit(float("nan"))).alias("pwis"), F.coalesce("prompt_accuracy", F.lit(float("nan"))).alias("prompt_accuracy"), *seeds)
    tasks = int(matched.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(tasks, min(4 * tasks, 128))  # blocks are small and slow: few of them in a task, and none put together
    drawn = rows.repartition(tasks, *pair, "_block").groupBy(*pair, "_block").applyInArrow(_sampler(reps, streams, leaf, digests, pair, names), schema)  # a block's prompts at most
    sums = drawn.groupBy(*pair, "stream", "column", "bin", "replicate").agg(*(F.sum(p).alias(p) for p in parts))
    bins = F.struct("bin", *parts)
    each = sums.groupBy(*pair, "stream", "replicate").agg(*(F.collect_list(F.when(F.col("column") == c, bins)).alias(f"c{c}") for c in range(3)))  # some bins
    # a replicate all of whose sums are 0 has no rows
    every = tops.select(*pair, "_top", "n_prompts", F.explode(F.sequence(F.lit(0), F.lit(len(streams) - 1))).alias("stream")).select("*", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("replicate"))
    every = every.withColumns({"stream": F.col("stream").cast("bigint"), "replicate": F.col("replicate").cast("bigint")})
    each = on_keys(every, each, [*pair, "stream", "replicate"], "left")
    kept = [*pair, "stream", "replicate", "_top", "n_prompts"]
    total, width, bits = _total, BIN, PART

    def finish(batches):
        import pyarrow as pa

        for batch in batches:
            made = [pa.array([total(x or [], parts, width, bits) for x in batch.column(f"c{c}").to_pylist()], pa.float64()) for c in range(3)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made], [*kept, "s0", "s1", "s2"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in each.select(*kept).schema) + ", s0 double, s1 double, s2 double"
    made = each.mapInArrow(finish, schema)
    n = F.col("n_prompts").cast("double")
    log_mean = F.col("_top") + F.ln("s0") - F.ln(n)
    highest = log_mean if paired or not digests else log_mean + F.ln(n)
    linear = F.when(F.col("s0") == 0, F.lit(0.0)).when(highest <= LOG_GREATEST, F.exp(log_mean))
    both = [("is", linear), ("prompt_wis", F.col("s1") / n)]
    use = both if paired else [(k, F.when(F.col("stream") == i, v)) for i, (k, v) in enumerate(both)]
    rows = made.select(*pair, "stream", "replicate", F.inline(F.array(*(F.struct(F.lit(k).alias("estimator"), v.alias("ope_estimate"), (F.col("s2") / n).alias("online_reference")) for k, v in use))))
    if not paired:
        rows = rows.where(F.col("stream") == F.when(F.col("estimator") == "is", 0).otherwise(1))
        rows = rows.withColumn("online_reference", F.when(F.col("ope_estimate").isNotNull(), F.col("online_reference")))
    error = F.col("ope_estimate") - F.col("online_reference")
    status = F.when(F.col("ope_estimate").isNull(), F.lit("nonfinite_estimator")).otherwise(F.lit("ok"))
    return rows.select(*pair, "estimator", F.col("replicate").cast("int").alias("replicate"), "ope_estimate", "online_reference", error.alias("signed_error"), F.abs(error).alias("absolute_error"), status.alias("estimator_status"))
