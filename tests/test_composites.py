"""Composite segmentation QC and the full hierarchical annotation against direct computation."""

import numpy as np
import pandas as pd
import pytest

from cellweave.functions import scalars as sc
from cellweave.operators import graph as gr
from cellweave.operators import permutations as pm
from cellweave.plans.tables import MARKERS


def scaled(v, low, high):
    lo, hi = np.quantile(v, low), np.quantile(v, high)
    return np.clip((v - lo) / (hi - lo + 1e-10), 0, 1)


def test_composite_segmentation_qc(spark):
    rng, parts = np.random.default_rng(3), []
    for s, n in (("a", 90), ("b", 40)):
        parts.append(pd.DataFrame({"sample_id": s, "cell_id": np.arange(n) + len(parts) * 1000, "admix": (rng.random(n) < 0.2).astype(float), "density": rng.poisson(9, n).astype(float), "edge": rng.gamma(2.0, 30.0, n), "genes": rng.integers(5, 90, n).astype(float)}))
    pdf = pd.concat(parts, ignore_index=True)
    got = {r.cell_id: r.composite_qc_score for r in sc.composite_segmentation_qc(spark.createDataFrame(pdf).repartition(4), ["sample_id"], "admix", "density", "edge", "genes").collect()}
    for _, g in pdf.groupby("sample_id"):
        near = 1 - np.clip(g["edge"] / np.quantile(g["edge"], 0.95), 0, 1)
        want = 0.4 * g["admix"] + 0.3 * scaled(g["density"], 0.05, 0.95) + 0.2 * near + 0.1 * (1 - scaled(g["genes"], 0.05, 0.95))
        assert [got[i] for i in g["cell_id"]] == pytest.approx(want.tolist(), abs=1e-9)


def signed(pdf, gate):
    score = pdf[list(gate.positive)].mean(axis=1)
    return score - 0.5 * pdf[list(gate.negative)].mean(axis=1) if gate.negative else score


def test_hierarchical_annotation_whole_path(spark):
    rng, n = np.random.default_rng(6), 160
    pdf = pd.DataFrame(rng.gamma(2.0, 1.0, (n, len(MARKERS))), columns=MARKERS).assign(cell_id=np.arange(n), sample_id=np.where(np.arange(n) % 3 == 0, "a", "b"), cluster=[f"k{i}" for i in rng.integers(0, 4, n)])
    for j, m in enumerate(("CD45", "PanCK", "aSMA", "CD31")):
        pdf.loc[np.arange(n) % 4 == j, m] += 4
    cells = sc.lineage_assignment(spark.createDataFrame(pdf).repartition(5), ["sample_id"])
    got = {r.cell_id: r for r in gr.hierarchical_annotation(cells, ["sample_id"], "cluster", sc.IMMUNE_SIGNED).collect()}
    assert len(got) == n
    seen = set()
    for _, g in pdf.groupby("sample_id"):
        g = g.reset_index(drop=True)
        s = np.column_stack([scaled(signed(g, t), 0.05, 0.95) for t in sc.LINEAGE_SIGNED])
        names, p = [t.label for t in sc.LINEAGE_SIGNED], np.exp(s / 2)
        lineage, confidence = [names[i] for i in s.argmax(1)], (p / p.sum(1, keepdims=True)).max(1)
        table, group = {}, pd.Series(lineage)
        immune = g[group == "Immune"]
        q = np.column_stack([scaled(signed(immune, t), 0.05, 0.95) for t in sc.IMMUNE_SIGNED])
        q = np.exp(2 * q) / np.exp(2 * q).sum(1, keepdims=True)
        for k in immune["cluster"].unique():
            at = (immune["cluster"] == k).to_numpy()
            mean = q[at].mean(0)
            mods = "+".join(label for label, m in gr.FUNCTIONAL_MARKERS.items() if immune[m][at].mean() > np.quantile(immune[m], 0.7))
            text = ("Low_confidence_" if mean.max() < gr.CONFIDENCE_CUTOFF else "") + sc.IMMUNE_SIGNED[mean.argmax()].label
            table["Immune", k] = (text + ("_" + mods if mods else ""), mean.max())
        epithelial = g[group == "Epithelial"]
        for k in epithelial["cluster"].unique():
            high = epithelial["KI67"][epithelial["cluster"] == k].mean() > np.quantile(epithelial["KI67"], 0.7)
            table["Epithelial", k] = ("Epithelial_proliferating" if high else "Epithelial", 0.8)
        for i, row in g.iterrows():
            other = gr.LINEAGE_DEFAULT.get(lineage[i], (lineage[i], 0.5))
            text, sure = table.get((lineage[i], row["cluster"]), other)
            mine = got[row["cell_id"]]
            assert mine.lineage == lineage[i] and mine.cell_type_detailed == text
            assert mine.cell_type_confidence == pytest.approx(0.7 * sure + 0.3 * confidence[i], abs=1e-9)
            words = text.split("_")
            assert mine.assigned_type == (words[-1] if text.startswith("Low") else words[0])
            seen.add(lineage[i])
    assert len(seen) >= 3


@pytest.mark.parametrize("many", [False, True])
def test_permuted_codes_are_hash_orders(spark, monkeypatch, many):
    import hashlib

    monkeypatch.setattr(pm, "RANGE", 16)  # several ranges a group
    rng, n_perm = np.random.default_rng(2), 5
    labels = {(s, i): f"t{rng.integers(0, 400 if many else 4)}" for s, n in (("a", 100), ("b", 37), ("c", 1)) for i in range(n)}
    rows = [(s, i, t) for (s, i), t in labels.items()] + [("a", 500, None)]
    df = spark.createDataFrame(rows, "s string, cell_id long, t string").repartition(6)
    p = pm.permuted_codes(df, ["s"], "cell_id", "t", n_perm, 9)
    assert p.kind == ("<u1" if len(p.labels) <= 256 else "<u2") and p.labels == sorted(set(labels.values()))
    names = {r.g: r.s for r in p.groups.collect()}
    got = {(names[r.g], r.id): [p.labels[k] for k in np.frombuffer(r.codes, p.kind)] for r in p.rows.collect()}
    for s in "abc":
        ids = sorted(i for g, i in labels if g == s)
        moved = [ids] + [sorted(ids, key=lambda i, q=q: hashlib.md5(f"9|{q}|{i}".encode()).hexdigest()) for q in range(1, n_perm + 1)]
        for at, i in enumerate(ids):
            assert got[s, i] == [labels[s, order[at]] for order in moved]
