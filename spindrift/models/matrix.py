"""Encoding inside a task: the same rules as operators.encode, on columns held as arrays."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pandas as pd


@dataclass
class Coded:
    """An encoded matrix without the zeros of its categories: the columns that every row holds and, for each categorical
    feature, the one column of it that a row holds. Its size does not grow with the number of categories."""

    dense: np.ndarray  # (rows, columns that every row holds), order F
    slot: np.ndarray  # of each column of the matrix: its number in dense, or -1 - k for a category of feature k
    codes: np.ndarray  # (categorical features, rows): column of the matrix that holds 1, or -1

    @classmethod
    def of(cls, x: np.ndarray | "Coded") -> "Coded":
        return x if isinstance(x, Coded) else cls(np.asfortranarray(x, dtype=float), np.arange(x.shape[1], dtype=np.int32), np.zeros((0, len(x)), np.int32))

    @property
    def shape(self) -> tuple[int, int]:
        return len(self.dense), len(self.slot)

    def __len__(self) -> int:
        return len(self.dense)

    def __getitem__(self, rows: slice | np.ndarray) -> "Coded":
        return Coded(np.asfortranarray(self.dense[rows]), self.slot, self.codes[:, rows])

    def at(self, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """Values at pairs of row and column."""
        s = self.slot[columns]
        if not len(self.codes):
            return self.dense[rows, s]
        hot = self.codes[np.maximum(-1 - s, 0), rows] == columns
        return np.where(s >= 0, self.dense[rows, np.maximum(s, 0)] if self.dense.shape[1] else 0.0, hot)

    def columns(self, places: np.ndarray) -> np.ndarray:
        """The columns at these places, with their zeros."""
        out = np.empty((len(self), len(places)), order="F")
        for i, c in enumerate(places):
            s = self.slot[c]
            out[:, i] = self.dense[:, s] if s >= 0 else self.codes[-1 - s] == c
        return out

    def var(self) -> float:
        """Variance of all entries."""
        n = max(1, self.shape[0] * self.shape[1])
        ones = int((self.codes >= 0).sum())
        mean = (self.dense.sum() + ones) / n
        return float((((self.dense - mean) ** 2).sum() + ones * (1 - mean) ** 2 + (n - self.dense.size - ones) * mean**2) / n)


def fit_matrix(df: pd.DataFrame, numeric: list[str], categorical: list[str], binary: list[str], min_frequency: int = 5, indicators: bool = False) -> dict:
    """Encoder state as plain JSON values: median and population SD, frequent categories, modes."""
    s = {"numeric": [], "categorical": [], "binary": [], "indicators": []}
    for c in numeric:
        v = df[c].to_numpy(float)
        ok = v[~np.isnan(v)]
        med = float(np.median(ok)) if len(ok) else 0.0
        v = np.where(np.isnan(v), med, v)
        mean, sd = (float(v.mean()), float(v.std())) if len(v) else (0.0, 1.0)
        s["numeric"].append([c, med, mean, sd if sd > 1e-12 * max(1.0, abs(mean)) else 1.0])
        if indicators and len(ok) < len(v):
            s["indicators"].append(c)
    for c in categorical:
        v = df[c]
        if isinstance(v.dtype, pd.CategoricalDtype):  # counted without a text for each row; the same counts
            codes, own = v.cat.codes.to_numpy(), v.cat.categories.astype(str)
            n = pd.Series(np.bincount(codes[codes >= 0], minlength=len(own)), index=own)
            n = n.add(pd.Series({"Unknown": int((codes < 0).sum())}), fill_value=0)
            n = n[n > 0]
        else:
            n = v.fillna("Unknown").astype(str).value_counts()
        s["categorical"].append([c, sorted(n[n >= min_frequency].index), sorted(n[n < min_frequency].index)])
    for c in binary:
        v = df[c].dropna()
        m = v.mode()
        s["binary"].append([c, float(m.iloc[0]) if len(m) else 0.0])
    return s


def matrix_names(s: dict) -> list[str]:
    out = [f"num__{c}" for c, *_ in s["numeric"]] + [f"num__missingindicator_{c}" for c in s["indicators"]]
    for c, often, rare in s["categorical"]:
        out += [f"cat__{c}_{v}" for v in often] + ([f"cat__{c}_infrequent"] if rare else [])
    return out + [f"bin__{c}" for c, _ in s["binary"]]


def apply_coded(s: dict, df: pd.DataFrame) -> Coded:
    """Categories are looked up in one hash table a feature, made at first use: time does not grow with their number."""
    n, first = len(df), len(s["numeric"]) + len(s["indicators"])
    if "_index" not in s:  # not part of the JSON
        s["_index"] = [pd.Index([*often, *rare], dtype=object) for _, often, rare in s["categorical"]]
    dense, codes = np.empty((n, first + len(s["binary"])), order="F"), np.full((len(s["categorical"]), n), -1, np.int32)
    slot, at = [np.arange(first)], first
    for i, (c, med, mean, sd) in enumerate(s["numeric"]):
        v = df[c].to_numpy(float)
        dense[:, i] = (np.where(np.isnan(v), med, v) - mean) / sd
    for i, c in enumerate(s["indicators"], len(s["numeric"])):
        dense[:, i] = np.isnan(df[c].to_numpy(float))
    for k, (c, often, rare) in enumerate(s["categorical"]):
        if isinstance(df[c].dtype, pd.CategoricalDtype):
            own = df[c].cat.categories
            of = np.append(s["_index"][k].get_indexer(own.astype(str)), s["_index"][k].get_indexer(["Unknown"]))
            place = of[df[c].cat.codes.to_numpy()]  # code -1 is null
        else:
            place = s["_index"][k].get_indexer(df[c].fillna("Unknown").astype(str).to_numpy(object))
        codes[k] = np.where(place >= 0, at + np.minimum(place, len(often)), -1)
        slot.append(np.full(len(often) + bool(rare), -1 - k))
        at += len(often) + bool(rare)
    for i, (c, mode) in enumerate(s["binary"], first):
        dense[:, i] = df[c].fillna(mode).to_numpy(float)
    slot.append(np.arange(first, dense.shape[1]))
    return Coded(dense, np.concatenate(slot).astype(np.int32), codes)


def apply_matrix(s: dict, df: pd.DataFrame) -> np.ndarray:
    """apply_coded with all zeros filled in, for a few rows."""
    x = apply_coded(s, df)
    out = np.zeros(x.shape, order="F")
    out[:, x.slot >= 0] = x.dense
    k, row = np.nonzero(x.codes >= 0)
    out[row, x.codes[k, row]] = 1.0
    return out


def dumps(s: dict) -> str:
    return json.dumps({k: v for k, v in s.items() if k != "_index"})


loads = json.loads
