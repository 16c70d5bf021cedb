"""Personal data: base patterns, and a skip-chain conditional random field that carries labels to other mentions.

Nodes are the tokens of a document that hold a digit or an @; all other tokens are fixed to "none", so chains are the maximal runs of
neighbouring nodes. Chain potentials join neighbours; skip potentials join each node with the next one, at any distance, that has
the same letters and digits, and with the next one that has the same key: the name before the @ of an address, or the last digits of a number, which may be
written over several tokens. Loopy message passing over both gives each node's marginal, so a mention whose form the patterns
miss takes the label of its other mentions. All weights are learned from a bounded sample of documents, with the patterns'
spans as labels: a softmax over shape features for nodes, smoothed log ratios for chain and skip potentials. That the patterns are silent about another form
of a mention they know is no evidence against it, so such nodes and links are left out.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import arrow_map, sample_texts

KINDS = ("email", "ip", "card", "phone")
LABELS = 1 + len(KINDS)
# documents the weights are learned from: those with the smallest hash of doc_id and text
SAMPLE = 3000
CERTAIN = 0.9
ROUNDS = 12
# numbers that end in the same so many digits may be one
TAIL = 7
# fixed values: the base patterns
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ANY = re.compile("[0-9@]")
NODE = re.compile(r"[0-9@][^\s]*")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, in order."""
    out = []
    if "@" in text:
        done = 0
        for m in DOMAIN.finditer(text):
            s = m.start()
            while s > done and text[s - 1] in LOCAL:
                s -= 1
            if s < m.start():
                out.append((s, 0, m.end()))
                done = m.end()
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def nodes(text: str) -> list[tuple[int, int]]:
    """Spans of the tokens between blanks that hold a digit or an @."""
    out, at = [], 0
    while m := ANY.search(text, at):
        s, e = m.start(), NODE.match(text, m.start()).end()
        while s > at and not text[s - 1].isspace():
            s -= 1
        out.append((s, e))
        at = e
    return out


def shape(token: str) -> list[str]:
    """Features of a token's form."""
    digits = sum(c in "0123456789" for c in token)
    form = re.sub("[0-9]+", "9", re.sub("[^\\W0-9_]+", "a", token))
    out = [f"form={form}", f"digits={min(digits, 20)}", f"dots={min(token.count('.'), 4)}", "bias"]
    out += [f"has={c}" for c in "@+()-.:" if c in token]
    if 12 <= digits <= 19 and digits == len(token.strip(".,;:!?")):
        out.append(f"luhn={luhn(''.join(c for c in token if c in '0123456789'))}")
    return out


def keyed(text: str, spans: list[tuple[int, int]], chained: list[bool]) -> list[str]:
    """Of each node the key that other forms of its mention share; empty where there is none.

    An address has its name; a number, joined over neighbouring tokens without letters, has its last digits, at its last token.
    """
    out, joined = [], ""
    numeric = [not any(c.isalpha() or c == "@" for c in text[s:e]) for s, e in spans]
    for k, (s, e) in enumerate(spans):
        token = text[s:e]
        if "@" in token:
            name = "".join(c for c in token.partition("@")[0].lower() if c.isalnum())
            out.append(f"name {name}" if len(name) >= 3 else "")
            joined = ""
            continue
        own = "".join(c for c in token if c in "0123456789")
        joined = (joined if chained[k] and numeric[k] and numeric[k - 1] else "") + own
        last = not (k + 1 < len(spans) and chained[k + 1] and numeric[k] and numeric[k + 1])
        out.append(f"tail {joined[-TAIL:]}" if last and len(joined) >= TAIL else "")
    return out


def described(text: str) -> tuple[list[tuple[int, int]], list[list[str]], list[bool], list[int], list[int]]:
    """Nodes, their features, whether each follows its predecessor in a chain, and the earlier nodes each is linked to by equal letters and digits and by its key (-1: none)."""
    spans = nodes(text)
    forms = [shape(text[s:e]) for s, e in spans]
    chained = [k > 0 and text[spans[k - 1][1] : s].strip(" ") == "" and s - spans[k - 1][1] <= 3 for k, (s, _) in enumerate(spans)]
    feats, seen, skip, similar = [], {}, [], []
    keys, known = keyed(text, spans, chained), {}
    for k, f in enumerate(forms):
        before = forms[k - 1][0] if chained[k] else "none"
        after = forms[k + 1][0] if k + 1 < len(forms) and chained[k + 1] else "none"
        feats.append([*f, f"before={before}", f"after={after}"])
        norm = "".join(c for c in text[spans[k][0] : spans[k][1]].lower() if c.isalnum())
        skip.append(seen.get(norm, -1) if len(norm) >= 4 else -1)
        seen[norm] = k
        similar.append(known.get(keys[k], -1) if keys[k] else -1)
        if similar[k] == skip[k]:
            similar[k] = -1
        known[keys[k]] = k
    return spans, feats, chained, skip, similar


def labels_of(spans: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> list[int]:
    out, at = [], 0
    for s, e in spans:
        while at < len(base) and base[at][2] <= s:
            at += 1
        out.append(1 + base[at][1] if at < len(base) and base[at][0] < e else 0)
    return out


def learn(texts: list[str]) -> dict:
    """Weights from the patterns' own labels: nodes by softmax regression, potentials by smoothed log ratios."""
    rows, gold, index = [], [], {}
    chain, skips = np.ones((LABELS, LABELS)), np.ones((LABELS, LABELS))
    np.fill_diagonal(skips, 3.0)
    for text in texts:
        spans, feats, chained, skip, similar = described(text)
        y = labels_of(spans, base_spans(text))
        # nodes the patterns leave out though their mention is known from another form
        silent = set()
        for k, j in enumerate(similar):
            if j >= 0 and (y[k] == 0) != (y[j] == 0):
                silent.add(k if y[k] == 0 else j)
        for k in range(len(feats) - 1, 0, -1):
            if k in silent and chained[k] and y[k - 1] == 0:
                silent.add(k - 1)
        for k, f in enumerate(feats):
            if k not in silent:
                rows.append([index.setdefault(x, len(index)) for x in f])
                gold.append(y[k])
            if chained[k] and not {k, k - 1} & silent:
                chain[y[k - 1], y[k]] += 1
            for j in (skip[k], similar[k]):
                if j >= 0 and not {k, j} & silent:
                    skips[y[j], y[k]] += 1
                    skips[y[k], y[j]] += 1
    weights = np.zeros((max(1, len(index)), LABELS))
    if rows:
        width = np.array([len(r) for r in rows])
        flat, owner, y = np.concatenate(rows), np.repeat(np.arange(len(rows)), width), np.eye(LABELS)[gold]
        step = np.zeros_like(weights)
        for _ in range(60):
            logits = np.add.reduceat(weights[flat], np.concatenate([[0], np.cumsum(width)[:-1]]))
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            error = p / p.sum(axis=1, keepdims=True) - y
            gradient = np.stack([np.bincount(flat, weights=error[owner, c], minlength=len(weights)) for c in range(LABELS)], axis=1)
            step += gradient**2
            weights -= 0.5 * (gradient + 0.01 * weights) / np.sqrt(step + 1e-8)
    ratio = lambda m: np.log(m * m.sum() / (m.sum(axis=1, keepdims=True) * m.sum(axis=0, keepdims=True)))
    return {"features": {f: weights[i].tolist() for f, i in index.items()}, "chain": ratio(chain), "skip": ratio(skips)}


def infer(feats: list[list[str]], chained: list[bool], skip: list[int], similar: list[int], model: dict, rounds: int = ROUNDS) -> np.ndarray:
    """Marginals of the nodes by loopy sum-product over chain and skip edges; one edge to each predecessor of any kind."""
    known, zero = model["features"], [0.0] * LABELS
    local = np.array([np.sum([known.get(x, zero) for x in f], axis=0) for f in feats])
    edges = [(k - 1, k, 0) for k in range(len(feats)) if chained[k]]
    edges += [(j[k], k, 1) for j in (skip, similar) for k in range(len(feats)) if j[k] >= 0 and not (chained[k] and j[k] == k - 1)]
    belief = local
    if edges:
        a, b, kind = (np.array(x) for x in zip(*edges))
        pot = np.stack([model["chain"], model["skip"]])[kind]
        forth, back = np.zeros((len(a), LABELS)), np.zeros((len(a), LABELS))  # messages a -> b and b -> a
        soft = lambda m: np.logaddexp.reduce(m, axis=1)
        for _ in range(rounds):
            belief = local.copy()
            np.add.at(belief, b, forth)
            np.add.at(belief, a, back)
            new_forth = soft((belief[a] - back)[:, :, None] + pot)
            new_back = soft((belief[b] - forth)[:, :, None] + pot.transpose(0, 2, 1))
            new_forth -= new_forth.max(axis=1, keepdims=True)
            new_back -= new_back.max(axis=1, keepdims=True)
            moved = max(np.abs(new_forth - forth).max(), np.abs(new_back - back).max())
            forth, back = (forth + new_forth) / 2, (back + new_back) / 2
            if moved < 1e-3:
                break
        belief = local.copy()
        np.add.at(belief, b, forth)
        np.add.at(belief, a, back)
    p = np.exp(belief - belief.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def all_spans(text: str, model: dict) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base, base with added): an added span is a run of nodes with one certain label that no base span touches."""
    if not ANY.search(text):
        return [], []
    base = base_spans(text)
    spans, feats, chained, skip, similar = described(text)
    added, covered = [], labels_of(spans, base)
    if any(c == 0 for c in covered):
        marginal = infer(feats, chained, skip, similar, model)
        best = marginal.argmax(axis=1)
        for k, (s, e) in enumerate(spans):
            if covered[k] or best[k] == 0 or marginal[k, best[k]] < CERTAIN:
                continue
            while s < e and not (text[s].isalnum() or text[s] in "+("):
                s += 1
            while e > s and not text[e - 1].isalnum():
                e -= 1
            if s == e:
                continue
            if added and chained[k] and added[-1][1] == best[k] - 1 and added[-1][2] >= spans[k - 1][0]:
                added[-1] = (added[-1][0], added[-1][1], e)
            else:
                added.append((s, int(best[k]) - 1, e))
    return base, sorted([*base, *added])


def fit(docs: DataFrame, sample: int = SAMPLE) -> dict:
    """The model, learned in one task from at most `sample` documents that hold a digit or an @."""
    texts = docs.select(F.col("text").cast("string").alias("text")).where(F.col("text").rlike("[0-9@]"))
    picked = sample_texts(texts, "text", sample)

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        import pickle

        return pd.DataFrame({"model": [pickle.dumps(learn(sorted(pdf["text"])))]})

    import pickle

    got = picked.withColumn("every", F.lit(0)).groupBy("every").applyInPandas(work, "model binary").collect()
    return pickle.loads(bytes(got[0]["model"])) if got else learn([])


def said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def op6(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per row: doc_id, counts and digest of base spans, all spans. Null texts are empty; repeated rows come back each."""
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, sample))  # weights of the forms in `sample` documents

    def work(batch: pa.RecordBatch) -> dict:
        model = held.value
        found = [all_spans(t, model) if t else ([], []) for t in batch.column(1).to_pylist()]
        counts = {f"n_{name}": [sum(x[1] == k for x in base) for base, _ in found] for k, name in enumerate(KINDS)}
        return {"doc_id": batch.column(0), **counts, "base_sha256": [hashlib.sha256(said(b).encode()).hexdigest() for b, _ in found], "spans": [said(a) for _, a in found]}

    out = {"doc_id": "long", **{f"n_{k}": "long" for k in KINDS}, "base_sha256": "string", "spans": "string"}
    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), out, work)
