"""A generative model of noisy voters, fitted by expectation-maximisation, and a logistic fit on soft labels."""

import numpy as np


def fit_votes(votes: np.ndarray, start: np.ndarray, belief: float = 0.8, strength: float = 0.2, silence: bool = True, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of class 1 for rows of votes (1 for, -1 against, 0 abstains); the voters' accuracies; their weights.

    Each class gives each voter its own chances of the three votes. start is a first guess of the posterior and only that: it
    breaks the symmetry of the classes, and each later posterior comes from the votes alone. Every voter's chances
    begin as those of a voter that is right in ``belief`` of its votes, with the weight of a share ``strength`` of the rows, so
    that chance doesn't make it an opponent. After a first fit, voters whose votes go together within a class share their weight: a voter counts
    1 / (1 + the sum of its positive residual correlations above 0.6 with the others). Without silence a voter that abstains says
    nothing, as when most voters know few texts, and the classes keep the shares of the start. An empty matrix gives the start back.
    """
    p = np.clip(start.astype(float), 0.01, 0.99)
    n, m = votes.shape
    weight, accuracy = np.ones(m), np.full(m, 0.5)
    if not n or not m:
        return p, accuracy, weight
    # rows alike in all votes are one row with a count
    told, back, many = np.unique(votes.astype(np.int8), axis=0, return_inverse=True, return_counts=True)
    back = back.ravel()
    many = many.astype(float)
    q = np.bincount(back, weights=p) / many
    kinds = [(told == v).astype(np.float32) for v in (1, -1, 0)]
    heavy = strength * n
    # a voter that casts its votes as often as this one, and gets so many of them right, by class
    cast = [many @ k for k in kinds]
    share = float(p.mean())
    prior = [[heavy * c / n * w for w in both] for c, both in zip(cast, ((belief / share, (1 - belief) / (1 - share)), ((1 - belief) / share, belief / (1 - share)), (1, 1)))]
    total = [sum(t[i] for t in prior) for i in (0, 1)]
    prior = [[t[i] * heavy / np.maximum(total[i], 1e-9) for i in (0, 1)] for t in prior]
    for fit in range(2):
        for _ in range(rounds):
            up_rows, down_rows = q * many, (1 - q) * many
            rate = np.clip(up_rows.sum() / n, 1e-4, 1 - 1e-4)
            if not silence:
                rate = np.clip(share, 1e-4, 1 - 1e-4)
            odds, tables = np.full(len(told), np.log(rate / (1 - rate))), []
            for kind, (a, b) in zip(kinds, prior):
                up = (up_rows @ kind + a + 1e-3) / (up_rows.sum() + heavy + 3e-3)
                down = (down_rows @ kind + b + 1e-3) / (down_rows.sum() + heavy + 3e-3)
                tables.append((up, down))
                if silence or kind is not kinds[2]:
                    odds += kind @ (weight * np.log(up / down))
            new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
            moved = np.abs(new - q).max()
            q = new
            if moved < 1e-4:
                break
        right = tables[0][0] * rate + tables[1][1] * (1 - rate)
        accuracy = right / np.maximum(right + tables[0][1] * (1 - rate) + tables[1][0] * rate, 1e-9)
        if fit == 0:
            excess = np.zeros((m, m))
            for part in (q * many, (1 - q) * many):
                mean = (part @ told) / max(part.sum(), 1e-9)
                rest = (told - mean) * np.sqrt(part)[:, None]
                cov = rest.T @ rest
                sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
                excess = np.maximum(excess, cov / np.outer(sd, sd))
            np.fill_diagonal(excess, 0)
            weight = 1 / (1 + np.where(excess > 0.6, excess, 0).sum(axis=1))
    return q[back], accuracy, weight


def fit_linear(rows: np.ndarray, columns: np.ndarray, width: int, target: np.ndarray, steps: int = 300, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model on 0/1 features, given as (row, column) pairs, for soft targets; Adam on whole batches."""
    w, b, n = np.zeros(width), 0.0, max(len(target), 1)
    m, v, mb, vb = np.zeros(width), np.zeros(width), 0.0, 0.0
    for t in range(1, steps + 1):
        z = b + np.bincount(rows, weights=w[columns], minlength=len(target))[: len(target)]
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / n
        g, gb = np.bincount(columns, weights=e[rows], minlength=width) + decay * w, e.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        lr, c1, c2 = 0.1, 1 - 0.9**t, 1 - 0.99**t
        w -= lr * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b -= lr * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    return w, b
