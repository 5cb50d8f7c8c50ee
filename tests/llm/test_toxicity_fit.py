"""The fit against the same steps written with dictionaries, document by document."""

import random
from math import exp, log, sqrt

import numpy as np
import pytest

from flowlens.llm import toxicity


def plain_fit(texts, labels, prior, rounds=100, rate=0.1, penalty=1e-3):
    """Weight of every feature with a ratio, and the bias."""
    features = [dict(zip(i.tolist(), c.tolist())) for i, c in map(toxicity.document_features, texts)]
    counts = [{}, {}]
    for found, label in zip(features, labels):
        for name, n in found.items():
            counts[label][name] = counts[label].get(name, 0) + n
    totals = [sum(c.values()) + 2 ** toxicity.BITS for c in counts]
    ratio = {}
    for name in counts[0].keys() | counts[1].keys():
        r = log((counts[1].get(name, 0) + 1) / totals[1]) - log((counts[0].get(name, 0) + 1) / totals[0])
        if counts[0].get(name, 0) + counts[1].get(name, 0) >= toxicity.LEAST_COUNT and abs(r) >= toxicity.LEAST_RATIO:
            ratio[name] = r
    values = [{k: n * ratio[k] for k, n in found.items() if k in ratio} for found in features]
    balance = [0.5 / labels.count(label) for label in labels]
    weights, seen, bias, seen_bias = dict.fromkeys(ratio, 0.0), dict.fromkeys(ratio, 1e-8), 0.0, 1e-8
    for _ in range(rounds):
        gradient, total = {k: penalty * w for k, w in weights.items()}, 0.0
        for row, label, part in zip(values, labels, balance):
            margin = sum(weights[k] * v for k, v in row.items()) + bias
            error = (1 / (1 + exp(-max(-30.0, min(30.0, margin)))) - label) * part
            for k, v in row.items():
                gradient[k] += error * v
            total += error
        for k, g in gradient.items():
            seen[k] += g * g
            weights[k] -= rate * g / sqrt(seen[k])
        seen_bias += total * total
        bias -= rate * total / sqrt(seen_bias)
    return {k: w * ratio[k] for k, w in weights.items()}, bias + log(prior / (1 - prior))


@pytest.mark.parametrize("chunk", [7, 256])
def test_fit_matches_plain_steps(monkeypatch, chunk):
    monkeypatch.setattr(toxicity, "CHUNK", chunk)
    rng = random.Random(3)
    words = ["river", "garden", "quiet", "stone", "letter", "window"]
    rude = ["vile", "scum", "idiot", "Trash"]
    texts, labels = [], []
    for n in range(200):
        label = int(n % 4 == 0)
        texts.append(" ".join(rng.choice(words + rude * label) for _ in range(rng.randint(1, 30))) if n % 50 else "")
        labels.append(label)
    weights, bias = plain_fit(texts, labels, 0.25)
    model = toxicity.fit([toxicity.document_features(t) for t in texts], np.array(labels), 0.25)
    expected = []
    for text in texts + ["a vile window", "unseen words only", None]:
        index, count = toxicity.document_features(text)
        odds = bias + sum(weights.get(i, 0.0) * c for i, c in zip(index.tolist(), count.tolist()))
        expected.append(1 / (1 + exp(-odds)))
    found = model.scores(texts + ["a vile window", "unseen words only", None], {})
    assert np.allclose(found, expected, atol=2e-3) and max(found) > 0.9 and min(found) < 0.1


def test_fit_is_the_same_for_any_chunk(monkeypatch):
    texts = [f"word{n % 7} {'vile scum' if n % 3 == 0 else 'calm'} thing" for n in range(90)]
    labels = np.array([int(n % 3 == 0) for n in range(90)])
    models = []
    for chunk in (1, 16, 1_000):
        monkeypatch.setattr(toxicity, "CHUNK", chunk)
        models.append(toxicity.fit([toxicity.document_features(t) for t in texts], labels, 0.3))
    for other in models[1:]:
        assert np.allclose(other.weights, models[0].weights, atol=1e-5) and abs(other.bias - models[0].bias) < 1e-6
