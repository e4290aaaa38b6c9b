"""Many controls counted against few wallets without sorting them: each is looked up among the wallets of its group."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value

# Workers get the functions of this module with the task, so the package need not be installed there.
register_pickle_by_value(sys.modules[__name__])


def _same(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal as Spark compares: NaN equals itself, as it comes last in either order."""
    return (a == b) | ((a != a) & (b != b))


class Wallets:
    """Wallets in order of group, score and place; equal scores of a group are one step.

    A control between two steps counts there, one on a step counts for the step, and for the wallet that it is the next ahead
    of: among equal scores the lesser place is ahead.
    """

    def __init__(self, group: np.ndarray, place: np.ndarray, score: np.ndarray):
        score = score.astype(float)
        self.order = np.lexsort((place, score, group))
        group, place, score = group[self.order], place[self.order], score[self.order]
        opens = np.ones(len(group), bool)
        opens[1:] = group[1:] != group[:-1]
        rises = opens.copy()
        rises[1:] |= ~_same(score[1:], score[:-1])
        self.groups, self.step, self.value = group[opens], np.cumsum(rises) - 1, score[rises]
        #: First wallet of each step and first step of each group, with the end.
        self.wallet = np.append(np.flatnonzero(rises), len(group))
        self.start = np.append(self.step[opens], len(self.value))
        self.places, rank = np.unique(place, return_inverse=True)
        self.key = self.step * (len(self.places) + 1) + rank
        #: Slots of the counts: between steps, on a step, ahead of a wallet on its step.
        self.slots = np.cumsum([len(self.value) + len(self.groups), len(self.value), len(group)])

    def count(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(slot, n) of the controls (group, place, score)."""
        total = np.zeros(self.slots[-1], np.int64)
        for batch in batches:
            group, place, score = (column.to_numpy(zero_copy_only=False) for column in batch.columns)
            if (group[1:] < group[:-1]).any():
                order = np.argsort(group, kind="stable")
                group, place, score = group[order], place[order], score[order]
            low, high = np.searchsorted(group, self.groups), np.searchsorted(group, self.groups, "right")
            for g in np.flatnonzero(low < high):
                self._add(total, g, place[low[g]:high[g]], score[low[g]:high[g]])
        slot = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(total[slot])], names=["slot", "n"])

    def _add(self, total: np.ndarray, g: int, place: np.ndarray, score: np.ndarray) -> None:
        start, end = self.start[g], self.start[g + 1]
        at = start + np.searchsorted(self.value[start:end], score)
        on = at < end
        on[on] = _same(self.value[at[on]], score[on])
        low, high = start + g, end + g + 1
        total[low:high] += np.bincount(at[~on] - start, minlength=high - low)
        step, place = at[on], place[on]
        total[self.slots[0] + start:self.slots[0] + end] += np.bincount(step - start, minlength=end - start)
        rank = np.searchsorted(self.places, place, "right")
        wallet = np.searchsorted(self.key, step * (len(self.places) + 1) + rank)
        first, last = self.wallet[start], self.wallet[end]
        ahead = wallet[wallet < self.wallet[step + 1]] - first
        total[self.slots[1] + first:self.slots[1] + last] += np.bincount(ahead, minlength=last - first)

    def metrics(self, slot: np.ndarray, n: np.ndarray, case: list[str],
                k: int) -> tuple[np.ndarray, list[str], np.ndarray, list[float | None]]:
        """Columns group, case, precision@k and ROC-AUC from the summed counts; `case` in the order the wallets were given."""
        total = np.zeros(self.slots[-1], np.int64)
        total[slot] = n
        between, on, ahead = np.split(total, self.slots[:2])
        ahead = np.cumsum(ahead)
        ahead -= np.concatenate([[0], ahead])[self.wallet[self.step]]
        found = pd.DataFrame({"case": np.array(case, object)[self.order], "step": self.step, "ahead": ahead})
        found["group"] = np.searchsorted(self.start, self.step, "right") - 1
        better, controls = np.zeros(len(on), np.int64), np.zeros(len(self.groups), np.int64)
        for g, (start, end) in enumerate(zip(self.start[:-1], self.start[1:])):
            above = between[start + g:end + g + 1].copy()
            above[1:] += on[start:end]
            upto = np.cumsum(above)
            controls[g] = upto[-1]
            better[start:end] = upto[-1] - upto[:-1] - on[start:end]
        found["ahead"] += better[self.step]
        # Whole numbers, twice the controls beaten, as a tie counts half.
        found["beaten"] = 2 * (controls[found["group"]] - better[self.step]) - on[self.step]
        # Wallets come by score and place: the best step first, within it the least place.
        found = found.sort_values(["group", "case", "step"], ascending=[True, True, False], kind="stable")
        found["hit"] = found.groupby(["group", "case"]).cumcount() + 1 + found["ahead"] <= k
        cases = found.groupby(["group", "case"]).agg(hits=("hit", "sum"), beaten=("beaten", "sum"), wallets=("hit", "size"))
        of, wallets = cases.index.get_level_values("group").to_numpy(int), cases["wallets"].to_numpy(int)
        precision = cases["hits"].to_numpy(int) / np.minimum(k, wallets + controls[of])
        pairs = controls[of] * 2.0 * wallets
        auc = [b / p if p else None for b, p in zip(cases["beaten"].tolist(), pairs.tolist())]
        return self.groups[of], cases.index.get_level_values("case").to_list(), precision, auc
