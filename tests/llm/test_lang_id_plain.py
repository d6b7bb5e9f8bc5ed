"""The byte network against one written with loops, its gradients against differences, and whole-text predictions window by window."""

import math

import numpy as np

from marlstone.llm import lang_id


def small():
    net = lang_id.ByteConvNet(["a", "b", "c"], seed=3)
    rng = np.random.default_rng(5)
    for part in net._parts():
        setattr(net, part, getattr(net, part).astype(np.float64))
    net.bias = rng.normal(0, 0.3, net.bias.shape)
    net.shift = rng.normal(0, 0.3, net.shift.shape)
    return net


def plain_logits(net, window):
    vectors = [net.bytes[b] for b in window]
    span, pooled = max(lang_id.WIDTHS), []
    for f in range(net.filters.shape[1]):
        width = lang_id.WIDTHS[f // lang_id.FILTERS]
        best = -math.inf
        for i in range(len(window) - span + 1):
            total = 0.0
            for k in range(width):
                for d in range(lang_id.DEPTH):
                    total += vectors[i + k][d] * net.filters[k * lang_id.DEPTH + d, f]
            best = max(best, total)
        pooled.append(max(0.0, best + net.bias[f]))
    return [sum(p * net.out[f, j] for f, p in enumerate(pooled)) + net.shift[j] for j in range(len(net.labels))]


def loss(net, windows, target):
    total = 0.0
    for w, t in zip(windows, target, strict=True):
        s = plain_logits(net, w)
        top = max(s)
        total -= s[t] - top - math.log(sum(math.exp(x - top) for x in s))
    return total / len(windows)


def test_windows_cover_whole_texts():
    data = ("Straße 12\tabc" * 40).encode()
    windows = lang_id.windows_of(data)
    seen = windows.reshape(-1)[: len(data)]
    assert len(windows) == -(-len(data) // lang_id.WINDOW) and (windows.reshape(-1)[len(data) :] == lang_id.PAD).all()
    want = bytes(32 if b < 33 or b == 127 else 48 if 48 <= b < 58 else b + 32 if 65 <= b < 91 else b for b in data)
    assert seen.tobytes() == want
    assert lang_id.windows_of(b"").shape == (0, lang_id.WINDOW)


def test_logits_are_those_of_loops():
    net = small()
    windows = np.concatenate([lang_id.windows_of(x) for x in ("der Hund und die Katze".encode(), "l'été à la mer ".encode() * 9, b"x")])[:, :24]
    got = net.logits(windows)
    for row, window in zip(got, windows, strict=True):
        assert np.allclose(row, plain_logits(net, window), atol=1e-9)


def test_gradients_are_those_of_differences():
    net = small()
    windows = np.concatenate([lang_id.windows_of(x) for x in (b"the cat and the dog", "el niño y la luz".encode(), b"und der ")])[:, :20]
    target = np.array([0, 1, 2])
    rng = np.random.default_rng(8)
    for part, gradient in zip(net._parts(), net._gradients(windows, target), strict=True):
        values = getattr(net, part)
        live = np.argwhere(net.mask > 0) if part == "filters" else np.argwhere(np.isin(np.arange(256), windows[windows > 0]))[:, :1] if part == "bytes" else np.argwhere(np.ones_like(values))
        for place in live[rng.permutation(len(live))[:6]]:
            at = (int(place[0]), int(rng.integers(lang_id.DEPTH))) if part == "bytes" else tuple(int(x) for x in place)
            step, old = 1e-6, values[at]
            values[at] = old + step
            up = loss(net, windows, target)
            values[at] = old - step
            down = loss(net, windows, target)
            values[at] = old
            assert abs((up - down) / (2 * step) - gradient[at]) < 1e-6, (part, at)


def test_predictions_are_the_mean_over_windows():
    net = small()
    texts = [("der Hund " * k).encode() for k in (1, 14, 15, 200)] + [b"z"]
    best, score = net.predict(texts)
    for k, data in enumerate(texts):
        windows = lang_id.windows_of(data)
        weight = [sum(b != lang_id.PAD for b in w) / lang_id.WINDOW for w in windows]
        logits = [plain_logits(net, w) for w in windows[:3]] if len(windows) <= 3 else net.logits(windows).tolist()
        mean = [sum(x[j] * w for x, w in zip(logits, weight, strict=True)) / sum(weight) for j in range(3)]
        p = np.exp(np.array(mean) - max(mean))
        p /= p.sum()
        assert best[k] == p.argmax() and abs(score[k] - p.max()) < 1e-6
