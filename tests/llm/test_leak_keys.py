"""Keys of walks: few windows are hashed in full, and none that agrees with an item is missed."""

import numpy as np

from reelgrid.llm import leaks


def test_few_windows_are_hashed_in_full_and_all_agreements_are_found(monkeypatch):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefghiklmnoprstu"), rng.integers(2, 9)))
    items = [(k, " ".join(word() for _ in range(40))) for k in range(30)]
    text = " ".join([word() for _ in range(3000)] + [leaks.edited(x, 0.05, rng) for _, x in items[:10]] + [items[11][1]])
    index = leaks._Index.of(items, leaks.EDIT_SHARE)
    (keys,) = index.classes
    buffer, starts, sizes = leaks._buffer([text])
    at, _ = leaks._word_starts(buffer, starts, sizes)
    walks, _ = leaks._walk(buffer, at)
    hashed = []
    full = leaks._key
    monkeypatch.setattr(leaks, "_key", lambda words, masks, lead, at: hashed.append(len(at)) or full(words, masks, lead, at))
    for n, sample in enumerate(keys.samples):
        got = {tuple(x) for x in keys.near(n, walks, leaks._words(walks)).T.tolist()}
        agree = (walks[sample][:, :, None] == keys.walks[sample][:, None, :]).all(0)
        close = (walks[: keys.steps, :, None] == keys.walks[:, None, :]).mean(0) >= leaks.NEAR
        assert got == {tuple(x) for x in np.argwhere(agree & close).tolist()} and got
    assert sum(hashed) < 0.25 * len(at) * len(keys.samples)
    found = {item for _, item, *_ in index.found([text])}
    assert found >= {*range(10), 11} - {k for k, x in items if len(x) < leaks.SHORT}
