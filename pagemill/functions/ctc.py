"""Greedy CTC decoding of logits (array of time steps, each an array of classes)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def best_classes(logits: Column) -> Column:
    """Arg-max of each step; the first of equal ones."""
    return F.transform(logits, lambda t: (F.array_position(t, F.array_max(t)) - 1).cast("int"))


def collapse(classes: Column) -> Column:
    """Of consecutive equal classes the first."""
    pairs = F.transform(classes, lambda c, i: F.struct(c.alias("c"), ((i == 0) | (c != F.element_at(classes, F.greatest(i, F.lit(1))))).alias("new")))
    return F.transform(F.filter(pairs, lambda p: p["new"]), lambda p: p["c"])


def text(logits: Column, vocabulary: str) -> Column:
    """Repeats collapse before blanks go; classes beyond the vocabulary are blank."""
    kept = F.filter(collapse(best_classes(logits)), lambda c: (c >= 0) & (c < len(vocabulary)))
    return F.array_join(F.transform(kept, lambda c: F.substring(F.lit(vocabulary), c + 1, F.lit(1))), "")


def step_confidence(step: Column) -> Column:
    top = F.array_max(step)
    return 1 / F.aggregate(step, F.lit(0.0), lambda a, x: a + F.exp(x.cast("double") - top))


def confidence(logits: Column) -> Column:
    """The least certain step's best probability, blanks included."""
    return F.array_min(F.transform(logits, step_confidence))


NEVER = float("-inf")


def _let(value: Column, then) -> Column:
    """then(value), with the value computed once; inlined into a lambda it would be computed for every element."""
    return F.get(F.transform(F.array(value), then), 0)


def _log_sum(*terms: Column) -> Column:
    def add(x: Column) -> Column:
        top = F.array_max(x)
        return F.when(top == NEVER, F.lit(NEVER)).otherwise(top + F.log(sum((F.exp(F.get(x, i) - top) for i in range(1, len(terms))), F.exp(F.get(x, 0) - top))))

    return _let(F.array(*terms), add)


def _log_probabilities(step: Column) -> Column:
    def less(top: Column) -> Column:
        total = F.log(F.aggregate(step, F.lit(0.0), lambda a, x: a + F.exp(x.cast("double") - top)))
        return _let(top + total, lambda t: F.transform(step, lambda x: x.cast("double") - t))

    return _let(F.array_max(step).cast("double"), less)


def loss(logits: Column, target: Column, blank: int) -> Column:
    """Negative log probability that the steps spell the target (classes), over all alignments.

    Zero where no alignment fits, as such rows teach nothing; null where logits or target are. Sums of logarithms, so long
    inputs do not underflow.
    """
    marks = F.concat(F.array(F.lit(blank)), F.flatten(F.transform(target, lambda c: F.array(c.cast("int"), F.lit(blank)))))

    def places(m: Column) -> Column:
        """Each mark, and whether it can be reached past the one before it."""
        return F.transform(m, lambda c, i: F.struct(c.alias("mark"), ((i == 1) | ((i > 1) & (c != blank) & (c != F.get(m, i - 2)))).alias("past")))

    def over(plan: Column) -> Column:
        # before the first step all weight lies on one place ahead of the marks, from which the first two can be reached
        start = F.concat(F.array(F.lit(0.0)), F.transform(plan, lambda p: F.lit(NEVER)))

        def walk(now: Column, told: Column) -> Column:
            def arrive(p: Column, i: Column) -> Column:
                two = F.when(p["past"], F.get(now, i - 1)).otherwise(F.lit(NEVER))
                return _log_sum(F.get(now, i + 1), F.get(now, i), two) + F.get(told, p["mark"])

            return F.concat(F.array(F.lit(NEVER)), F.transform(plan, arrive))

        def finish(now: Column) -> Column:
            # without steps the weight is still ahead, and spells the empty target only
            ends = F.when(F.size(now) == 2, _log_sum(F.get(now, 0), F.get(now, 1))).otherwise(_log_sum(F.get(now, F.size(now) - 1), F.get(now, F.size(now) - 2)))
            return F.when(ends == NEVER, F.lit(0.0)).otherwise(-ends)

        return F.aggregate(F.transform(logits, _log_probabilities), start, walk, finish)

    return F.when(logits.isNotNull() & target.isNotNull(), _let(_let(marks, places), over))


def mean_loss(loss: Column, target: Column) -> Column:
    """The mean over rows of the loss by letter of the target (one at least): an aggregate."""
    return F.avg(loss / F.greatest(F.size(target), F.lit(1)))
