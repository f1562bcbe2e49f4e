import re
from collections import Counter

import numpy as np
from llm_cases import ODD

from patchloom.llm import weak_rules as W


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    held = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    lines = text.split("\n")
    dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
    n = len(words)
    failed = n < 50 or 100 * len(held) > 50 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(held), failed


ROWS = [
    (10, "a b c a b c d"), (11, "x\nx\n\n \ny\nx"), (12, "a a a a"), (13, "é# *$ \x1c|<>"), (14, " ".join(map(str, range(60)))),
    (15, "the same three " * 40), (16, "\n".join(["one line here"] * 30 + [f"w{k} q{k}" for k in range(100)])),
]


def test_measures_and_base(documents):
    rows = ROWS + [r for r in ODD if r[0] != 4] + [(4, "word " * 3000)]
    got = W.label(documents(rows).repartition(3)).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter((r.doc_id, *(r[n] for n in names)) for r in got) == Counter((d, *plain(t)) for d, t in rows)
    assert all(r.kept == (not r.base_failed and r.quality >= 0.5) for r in got)
    assert W.label(documents([])).count() == 0


def test_many_different_words_keep_their_windows():
    words = [f"w{k}" for k in range(3000)]
    assert W.measure(" ".join(words + words[:3]))[4] == 6


def test_fit_finds_planted_accuracies():
    rng = np.random.default_rng(2)
    good, on_good, on_bad, speaks = rng.random(80_000) < 0.8, [0.998, 0.996, 0.997, 0.998, 0.996], [0.6, 0.3, 0.5, 0.8, 0.4], [1, 0.8, 0.9, 0.7, 1]
    votes = np.stack([
        np.where(rng.random(good.size) < s, np.where(good, np.where(rng.random(good.size) < g, 1, -1), np.where(rng.random(good.size) < b, -1, 1)), 0)
        for g, b, s in zip(on_good, on_bad, speaks)
    ], axis=1)
    seen, counts = np.unique(votes, axis=0, return_counts=True)
    model = W.fit(seen, counts.astype(float))
    assert abs(model.prior - 0.8) < 0.02 and np.abs(model.bad - on_bad).max() < 0.05 and np.abs(model.good - on_good).max() < 0.002
    said = model.posterior(votes) >= 0.5
    strict = (votes >= 0).all(axis=1)  # all must pass
    assert (said == good).mean() >= (strict == good).mean() and (said == good).mean() > 0.95


def test_silent_rules_leave_the_prior():
    silent = np.zeros((1, 4), np.int64)
    model = W.fit(silent, np.array([9.0]))
    assert np.allclose(model.posterior(silent), model.prior) and np.allclose(model.bad, W.FIRST_BAD)


def test_junk_is_not_kept(documents):
    rng = np.random.default_rng(3)
    words = [f"plain{k}" for k in range(400)]

    def text(n=150):
        return " ".join(rng.choice(words, n))

    clean = [(k, text() + ".\n" + text()) for k in range(300)]
    junk = [(1000 + k, text().replace(" ", rng.choice(["### ", " | ", "%%% "]))) for k in range(12)]
    junk += [(2000 + k, text().upper().replace(" ", "!! ")) for k in range(12)]
    junk += [(3000 + k, " ".join(f"{w} " * 12 for w in rng.choice(words, 12))) for k in range(12)]
    got = {r.doc_id: r.kept for r in W.label(documents(clean + junk)).collect()}
    assert all(got[d] for d, _ in clean) and not any(got[d] for d, _ in junk)
