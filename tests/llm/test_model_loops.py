"""The trained models against slow loops: label model, convolution with pooling, cumulative link."""

import math

import numpy as np

from lectern.llm import grades, language, toxicity


def test_label_model_posterior_and_accuracies():
    """One step of expectation maximisation, voter by voter and mask by mask."""
    rng = np.random.default_rng(4)
    masks = np.unique(rng.integers(0, 1 << toxicity.VOTERS, 60))
    counts = rng.integers(1, 50, len(masks)).astype(float)
    known = rng.integers(-1, 2, len(masks))
    model = toxicity.LabelModel(masks, known, counts)
    parent, speak, prior = model.parent, model.speak, model.prior
    bit = lambda m, v: (int(m) >> v) & 1

    posterior = []
    for m in masks:
        logs = []
        for y in (0, 1):
            total = math.log((1 - prior, prior)[y] + 1e-9)
            for v in range(toxicity.VOTERS):
                p = min(max(speak[v, y, bit(m, parent[v]) if parent[v] >= 0 else 0], 1e-6), 1 - 1e-6)
                total += math.log(p if bit(m, v) else 1 - p)
            logs.append(total)
        posterior.append(1 / (1 + math.exp(min(max(logs[0] - logs[1], -50), 50))))
    assert np.allclose(model.posterior(masks), posterior, rtol=1e-9)

    clamped = [p if k < 0 else 0.95 * k + 0.05 * p for p, k in zip(posterior, known)]
    votes = (masks[:, None] >> np.arange(toxicity.VOTERS)) & 1
    model._accuracies(votes, np.array(clamped), counts)
    for v in range(toxicity.VOTERS):
        for y in (0, 1):
            weight = [c * (p if y else 1 - p) for c, p in zip(counts, clamped)]
            base = sum(w for w, m in zip(weight, masks) if bit(m, v)) / sum(weight)
            for u in (0, 1):
                inside = [(w, m) for w, m in zip(weight, masks) if (bit(m, parent[v]) if parent[v] >= 0 else 0) == u]
                want = (sum(w for w, m in inside if bit(m, v)) + 2 * base + 1e-3) / (sum(w for w, _ in inside) + 2.01)
                assert math.isclose(model.speak[v, y, u], want, rel_tol=1e-9)
    # parents form a tree: everybody reaches voter 0
    for v in range(toxicity.VOTERS):
        steps = 0
        while v != 0:
            v, steps = parent[v], steps + 1
            assert v >= 0 and steps < toxicity.VOTERS


def test_convolution_with_pooling():
    """Filters of every width slid over a window, the best answer of each, softmax."""
    rng = np.random.default_rng(9)
    net = language.Network(["a", "b", "c"])
    windows = rng.integers(0, 257, (3, language.WINDOW)).astype(np.int16)
    windows[2, 40:] = 0
    got = net.log_probabilities(windows)
    wide = max(language.WIDTHS)
    for x, row in zip(windows.tolist(), got):
        answers = []
        for k in range(len(language.WIDTHS) * language.FILTERS):
            width = language.WIDTHS[k // language.FILTERS]
            best = max(
                sum(float(net.p["embed"][x[i + j], e]) * float(net.p["filters"][j, e, k])
                    for j in range(width) for e in range(language.EMBEDDING))
                for i in range(language.WINDOW - wide + 1))
            answers.append(max(best + float(net.p["bias"][k]), 0.0))
        z = [sum(a * float(net.p["out"][k, c]) for k, a in enumerate(answers)) + float(net.p["shift"][c]) for c in range(3)]
        total = math.log(sum(math.exp(v) for v in z))
        assert np.allclose(row, [v - total for v in z], atol=1e-4)


def test_a_training_step_follows_the_gradient():
    """The loss on separable windows falls, and a numeric gradient agrees in sign with a step."""
    rng = np.random.default_rng(3)
    net = language.Network(["a", "b"])
    windows = np.zeros((80, language.WINDOW), np.int16)
    target = np.arange(80) % 2
    for i, y in enumerate(target):
        windows[i] = rng.choice([98, 99, 100] if y else [101, 102, 103], language.WINDOW)
    loss = lambda: -net.log_probabilities(windows)[np.arange(80), target].mean()
    before = loss()
    net.fit(windows, target, steps=60)
    assert loss() < 0.1 * before


def test_cumulative_link_probabilities():
    """P(grade > k), the expected grade, and that the likelihood rises, by plain loops."""
    rng = np.random.default_rng(5)
    model = grades.Ordinal(4)
    rows, rating = [], []
    for _ in range(300):
        y = int(rng.integers(0, 4))
        bucket = rng.choice(np.arange(y * 10, y * 10 + 14), 5, replace=False).astype(np.uint16)
        rows.append((bucket, np.full(5, 5 ** -0.5, np.float32)))
        rating.append(y)
    rating = np.array(rating)

    def likelihood():
        total = 0.0
        for (bucket, value), y in zip(rows, rating):
            z = sum(model.weights[b] * v for b, v in zip(bucket, value))
            above = [1.0, *(1 / (1 + math.exp(-(z - t))) for t in model.thresholds), 0.0]
            assert all(a >= b for a, b in zip(above, above[1:]))
            total += math.log(above[y] - above[y + 1])
        return total

    before = likelihood()
    model.fit(rows, rating)
    assert likelihood() > before / 2 and (np.diff(model.thresholds) >= 0).all()
    text = np.repeat(np.arange(len(rows)), 5)
    tails = model.tails(text, np.concatenate([b for b, _ in rows]).astype(np.int64), np.concatenate([v for _, v in rows]), len(rows))
    for i, (bucket, value) in enumerate(rows):
        z = sum(model.weights[b] * float(v) for b, v in zip(bucket, value))
        assert np.allclose(tails[i], [1 / (1 + math.exp(-(z - t))) for t in model.thresholds], rtol=1e-9)
    right = (np.abs(tails.sum(1) - rating) < 0.7).mean()
    assert right > 0.8
