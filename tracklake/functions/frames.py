"""Frame indices, targets, bins and padding as array expressions.

The eight ways of taking fewer frames are different functions with different results and
are kept apart.  ``n`` is the number of frames; all indices are from 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Number = Column | int | float | str


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _empty(kind: str = "int") -> Column:
    return F.array().cast(f"array<{kind}>")


def all_indices(n: Column) -> Column:
    """0 .. n-1; empty for n < 1."""
    return F.when(n >= 1, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(_empty())


def _steps(k: Number) -> Column:
    return F.sequence(F.lit(0), (_c(k) - 1).cast("int"))


def _linspace(i: Column, n: Column, k: Number) -> Column:
    return i * ((n - 1) / F.greatest(_c(k) - 1, F.lit(1)))


def _floored(i: Column, n: Column, k: Number) -> Column:
    """Rounded down; the last of several is the end itself, whatever the rounding of the step."""
    return F.when((_c(k) > 1) & (i == _c(k) - 1), n - 1).otherwise(F.floor(_linspace(i, n, k))).cast("int")


def linspace_indices(n: Column, k: int) -> Column:
    """Evenly spaced with both ends, rounded half to even; all if n <= k, the last if k = 1."""
    if k == 1:
        return F.when(n <= 1, all_indices(n)).otherwise(F.array((n - 1).cast("int")))
    return F.when(n <= k, all_indices(n)).otherwise(F.transform(_steps(k), lambda i: F.rint(_linspace(i, n, k)).cast("int")))


def floor_indices(n: Column, k: Number, distinct: bool = True) -> Column:
    """Evenly spaced with both ends, rounded down; duplicates dropped or kept; k = -1 takes all."""
    if isinstance(k, int) and k < 0:
        return all_indices(n)
    out = F.transform(_steps(k), lambda i: _floored(i, n, k))
    return F.when(n <= k, all_indices(n)).otherwise(F.array_distinct(out) if distinct else out)


def stride_indices(n: Column, k: int) -> Column:
    """int(i n / k): never the last frame unless n <= k."""
    return F.when(n <= k, all_indices(n)).otherwise(F.transform(_steps(k), lambda i: F.floor(i * n / k).cast("int")))


def ends_and_middle_indices(n: Column, k: int, offset: float = 0.5) -> Column:
    """Both ends and k - 2 frames between them, sorted and distinct."""
    middle = F.transform(_steps(max(k - 2, 1)), lambda i: F.floor(1 + (i + offset) * (n - 2) / max(k - 2, 1)).cast("int"))
    return F.when(n <= k, all_indices(n)).otherwise(F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0)), middle, F.array((n - 1).cast("int"))))))


def fps_indices(n: Column, native_fps: Number, fps: Number, max_frames: int) -> Column:
    """round(n fps / native_fps) frames, between 1 and n and at most max_frames, evenly spaced and rounded down."""
    k = F.least(F.greatest(F.rint(n * _c(fps) / _c(native_fps)).cast("int"), F.lit(1)), n.cast("int"), F.lit(max_frames))
    return F.when(n < 1, _empty()).otherwise(F.transform(_steps(k), lambda i: _floored(i, n, k)))


def interval_indices(n: Column, native_fps: Number, fps: Number) -> Column:
    """Every max(1, int(native_fps / fps))-th frame."""
    step = F.greatest(F.lit(1), F.floor(_c(native_fps) / _c(fps)).cast("int"))
    return F.filter(all_indices(n), lambda i: i % step == 0)


def hashed_subset(n: Column, k: int, *key: Column | str) -> Column:
    """k frames in order, chosen by a hash of the key and the frame; all if n <= k."""
    ranked = F.array_sort(F.transform(all_indices(n), lambda i: F.struct(F.md5(F.concat_ws("|", *key, i.cast("string"))).alias("h"), i.alias("i"))))
    return F.array_sort(F.transform(F.slice(ranked, 1, k), lambda x: x["i"]))


def segment_walk(start: Column, middle: Column, end: Column) -> Column:
    """start .. middle .. end in steps of one in either direction, with the middle once."""
    back = F.sequence(middle, end)
    return F.concat(F.sequence(start, middle), F.slice(back, 2, F.greatest(F.size(back) - 1, F.lit(0))))


def segment_indices(total: Column, start: Column, end: Column, middle: Column | None = None, max_frames: int = 8) -> Column:
    """The walk start, middle, end with all of them held to the frames there are; without a middle straight to the end.

    One frame: that; two frames: both (the first if only one is asked for); no end, or one
    frame asked for: the start.
    """
    held = lambda x: F.greatest(F.lit(0), F.least(x, total - 1)).cast("int")
    a, c = held(start), held(end)
    straight = F.sequence(a, c)
    out = straight if middle is None else F.when(middle.isNull(), straight).otherwise(segment_walk(a, held(middle), c))
    out = F.when(end.isNull() | F.lit(max_frames == 1), F.array(a)).otherwise(out)
    two = F.array(F.lit(0)) if max_frames == 1 else F.array(F.lit(0), F.lit(1))
    return F.when(total == 1, F.array(F.lit(0))).when(total == 2, two).otherwise(out)


def subsample_ends(direction: str, n: Column, max_frames: int, *key: Column | str) -> Column:
    """(start, middle, end) of a walk over n frames, drawn by a hash of the key; null where there are too few frames.

    One frame asked for: any.  Two: any but the last, then any after it; reverse swaps
    them.  More: three of the frames in the order of the direction; bidirectional takes
    forward, rewind or reverse, each alike.
    """
    null = F.lit(None).cast("int")

    def upto(name: str, most: Column) -> Column:
        """A whole number from 0 to most - 1."""
        u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(name), *key)), 1, 8), 16, 10).cast("double") / float(2**32)
        return F.floor(u * most).cast("int")

    def ends(start: Column, middle: Column, end: Column) -> Column:
        return F.struct(start.cast("int").alias("start"), middle.cast("int").alias("middle"), end.cast("int").alias("end"))

    if max_frames == 1:
        return F.when(n >= 1, ends(upto("one", n), null, null))
    if max_frames == 2:
        low = upto("low", n - 1)
        high = low + 1 + upto("high", n - 1 - low)
        return F.when(n >= 2, ends(high, null, low) if direction == "reverse" else ends(low, null, high))
    a, b, c = (F.try_element_at(hashed_subset(n, 3, *key), F.lit(k)) for k in (1, 2, 3))
    forms = {"forward": ends(a, b, c), "rewind": ends(a, c, b), "reverse": ends(c, b, a)}
    which = upto("direction", F.lit(3))
    any_ = F.when(which == 0, forms["forward"]).when(which == 1, forms["rewind"]).otherwise(forms["reverse"])
    return F.when(n >= 3, forms.get(direction, any_))


def walk(direction: str, three: Column) -> Column:
    """A walk over three sorted frames: forward, reverse or rewind."""
    a, b, c = (F.element_at(three, k) for k in (1, 2, 3))
    forms = {"forward": (a, b, c), "reverse": (c, b, a), "rewind": (a, c, b)}
    return F.when(F.size(three) == 3, F.array(*forms[direction]))


def absolute_progress(indices: Column, total: Column, cutoff: Number = 1.0) -> Column:
    """(i + 1) / total; 1 from the cutoff frame on."""
    cut = F.floor(_c(cutoff) * total)
    return F.transform(indices, lambda i: F.when(i >= cut, F.lit(1.0)).otherwise((i + 1) / total))


def _once(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def first_frame_progress(indices: Column, total: Column, cutoff: Number | None = None) -> Column:
    """(i - s) / max(1, total - s - 1) from the least index s; with a cutoff min(1, (i - s) / max(1, int(cutoff total) - s - 1))."""

    def since(s: Column) -> Column:
        if cutoff is None:
            return F.transform(indices, lambda i: (i - s) / F.greatest(F.lit(1), total - s - 1))
        cut = F.floor(_c(cutoff) * total)
        return F.transform(indices, lambda i: F.least(F.lit(1.0), (i - s) / F.greatest(F.lit(1), cut - s - 1)))

    return _once(F.array_min(indices), since)


def deltas(values: Column) -> Column:
    """0, then each value less the one before."""
    return _once(values, lambda v: F.transform(v, lambda x, i: F.when(i == 0, F.lit(0.0)).otherwise(x - F.get(v, i - 1))))


def running_sum(values: Column) -> Column:
    """The inverse of deltas, up to the first value: sums over 1, 2, 4, ... places, so n log n for n values."""

    def summed(v: Column) -> Column:
        steps = F.filter(F.array(*[F.lit(1 << k) for k in range(31)]), lambda s: s < F.size(v))
        return F.aggregate(steps, v, lambda a, s: F.transform(a, lambda x, i: F.when(i >= s, x + F.get(a, i - s)).otherwise(x)))

    return _once(values.cast("array<double>"), summed)


def partial_success_progress(indices: Column, progress: Column, total: Column, partial: Column) -> Column:
    """With a partial success other than 1 and the last frame present: zeros, and it at the first last frame."""
    last = F.array_position(indices, (total - 1).cast("int"))
    changed = partial.isNotNull() & (partial != 1.0) & (last > 0)
    return F.when(changed, F.transform(progress, lambda x, i: F.when(i + 1 == last, partial).otherwise(F.lit(0.0)))).otherwise(progress)


def success_labels(progress: Column, quality: Column, threshold: Column) -> Column:
    """Zeros for failure-like rows, whatever the case of their label; else 1 where the progress reaches the threshold."""
    bad = F.coalesce(F.lower(quality).isin("suboptimal", "failure", "failed"), F.lit(False))
    return F.transform(progress, lambda p: F.when(~bad & (p >= threshold), 1.0).otherwise(0.0))


def last_frame_mask(indices: Column, total: Column, partial: Column, preference_only: Column | None = None) -> Column:
    """Ones; for partial success only at the positions of the last frame.  A whole success counts as partial in preference-only sources."""
    whole = partial == 1.0
    if preference_only is not None:
        whole &= ~F.coalesce(preference_only, F.lit(False))
    return F.transform(indices, lambda i: F.when(partial.isNull() | whole | (i == total - 1), 1.0).otherwise(0.0))


def pad(values: Column, k: int, left: bool = False) -> Column:
    """Repeats the last (or, on the left, the first) value up to k values; an empty array stays empty."""
    n = F.greatest(F.lit(0), k - F.size(values))
    filled = F.array_repeat(F.get(values, F.lit(0)), n) if left else F.array_repeat(F.get(values, F.size(values) - 1), n)
    return F.when(F.size(values) == 0, values).otherwise(F.concat(filled, values) if left else F.concat(values, filled))


def pad_zero(values: Column, k: Column) -> Column:
    """Zeros up to k values."""
    return F.concat(values, F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), k - F.size(values))))


def padding_mask(n: Column, k: Column) -> Column:
    """k values, 1 for the first n."""
    return F.when(k >= 1, F.transform(F.sequence(F.lit(0), (k - 1).cast("int")), lambda i: F.when(i < n, 1.0).otherwise(0.0))).otherwise(_empty("double"))


def _clamped(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


def discrete_bin(value: Column, bins: int) -> Column:
    """The bin of a value clamped to 0..1, rounded half to even."""
    return F.rint(_clamped(value) * (bins - 1)).cast("int")


def two_hot(value: Column, bins: int) -> Column:
    """Weights of the two neighbouring bins by linear interpolation."""
    x = _clamped(value) * (bins - 1)
    return F.transform(_steps(bins), lambda b: F.greatest(F.lit(0.0), 1 - F.abs(x - b)))


def two_hot_series(values: Column, bins: int) -> Column:
    return F.transform(values, lambda v: two_hot(v, bins))


def bins_to_value(bins: Column, is_prob: bool) -> Column:
    """The mean of the bin centres, from probabilities or by softmax from logits."""
    top = F.array_max(bins)
    weights = bins if is_prob else F.transform(bins, lambda x: F.exp(x - top))
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    scale = F.greatest(F.size(bins) - 1, F.lit(1))
    mean = F.aggregate(F.transform(weights, lambda x, i: x * i / scale), F.lit(0.0), lambda a, x: a + x)
    return mean if is_prob else mean / total


def bins_to_value_hard(bins: Column) -> Column:
    """The centre of the greatest bin, the first of equal ones."""
    return (F.array_position(bins, F.array_max(bins)) - 1) / F.greatest(F.size(bins) - 1, F.lit(1))


def bin_center(index: Column, bins: int) -> Column:
    return index / (bins - 1)


def prefix_ends(total: Column, step: int) -> Column:
    """step, 2 step, ... up to total."""
    return F.when(total >= step, F.sequence(F.lit(step), total.cast("int"), F.lit(step))).otherwise(_empty())


def spaced_ends(total: Column, k: int) -> Column:
    """k prefix ends from 1 to total, evenly spaced and cut to whole numbers."""
    return F.transform(_steps(k), lambda i: F.when((i == k - 1) & F.lit(k > 1), total).otherwise(F.floor(1 + i * ((total - 1) / max(k - 1, 1)))).cast("int"))


def gather(values: Column, indices: Column) -> Column:
    return F.transform(indices, lambda i: F.get(values, i))


def resize_geometry(width: Column, height: Column, shortest: int, crop: bool = False) -> Column:
    """Where a frame is cut (x, y: the middle square if ``crop``) and its width and height then: the shortest edge as given, cut to whole numbers, odd ones one more."""
    edge = F.least(width, height)
    x, y = ((F.floor((side - edge) / 2) if crop else F.lit(0)).cast("int") for side in (width, height))
    cut = lambda side: F.floor((edge if crop else side) * (F.lit(float(shortest)) / edge)).cast("int")
    even = lambda n: n + n % 2
    return F.struct(x.alias("x"), y.alias("y"), even(cut(width)).alias("width"), even(cut(height)).alias("height"))


def discrete_target(target: Column, bins: int) -> Column:
    """The value of a bin's index."""
    return target / (bins - 1)


def shuffled(n: Column, *key: Column | str) -> Column:
    """A permutation of 0 .. n-1 by a hash of the key that leaves the first frame where it is."""
    rest = F.filter(all_indices(n), lambda i: i > 0)
    drawn = F.array_sort(F.transform(rest, lambda i: F.struct(F.md5(F.concat_ws("|", *key, i.cast("string"))).alias("h"), i.alias("i"))))
    return F.when(n >= 1, F.concat(F.array(F.lit(0)), F.transform(drawn, lambda x: x["i"]))).otherwise(_empty())


def unshuffled(values: Column, permutation: Column) -> Column:
    """Values that stand in the order of the permutation, in the order of the frames; frames without a value are left out."""
    placed = F.transform(F.arrays_zip(permutation.alias("i"), values.alias("v")), lambda x: F.struct(x["i"].alias("i"), x["v"].alias("v")))
    return F.transform(F.array_sort(F.filter(placed, lambda x: x["i"].isNotNull() & x["v"].isNotNull())), lambda x: x["v"])


def every_other(values: Column, first: int) -> Column:
    """The values at even places (first = 0) or at odd ones."""
    return F.filter(values, lambda _, k: k % 2 == first)
