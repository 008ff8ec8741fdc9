"""Plain Python versions of the operators, written from their contracts."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACES = " \t\n\x0b\x0c\r"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

#: Texts that every operator must take: nulls, blanks, ties, odd characters.
ODD_TEXTS = [
    None,
    "",
    " ",
    "\n\n",
    "one",
    "Straße und Öl — 東京 ☃ ²½",
    "a b c\x1cd\x85e",
    "İstanbul ΣΑΣ ſ K",
    "x" * 5000,
    "tab\tand\rreturn\x0bvt\x0cff",
    "same words here again\nsame words here again\nsame words here again",
]


def some_texts(seed: int, n: int, words: int = 60, vocabulary: int = 40) -> list[str]:
    """Seeded prose with repeated lines and shared passages."""
    rng = random.Random(seed)
    names = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 7))) for _ in range(vocabulary)]
    shared = [" ".join(rng.choice(names) for _ in range(14)) + "." for _ in range(3)]
    out = []
    for _ in range(n):
        lines = []
        for _ in range(rng.randint(1, 5)):
            line = " ".join(rng.choice(names) for _ in range(rng.randint(1, words // 3)))
            lines += [line] * rng.choice([1, 1, 1, 2])
        if rng.random() < 0.5:
            lines.insert(rng.randint(0, len(lines)), rng.choice(["", "  "]) + rng.choice(shared).upper())
        out.append("\n".join(lines))
    return out


def repetition(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    repeated = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    chars = sum(map(len, words))
    shares = []
    for n in range(5, 11):
        grams = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
        inside = {j for i in range(len(words) - n + 1) if grams[tuple(words[i : i + n])] > 1 for j in range(i, i + n)}
        shares.append(sum(len(words[j]) for j in inside) / max(chars, 1))
    failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
    dup_chars = sum(map(len, lines)) - sum(map(len, set(lines)))
    bad = (
        len(lines) - len(set(lines)) > 0.5 * len(lines)
        or dup_chars > 0.3 * sum(map(len, lines))
        or any(s > t for s, t in zip(shares, (0.45, 0.42, 0.39, 0.36, 0.33, 0.30), strict=True))
    )
    symbols = sum(c in "#*$%&|<>" for c in text)
    return (
        len(words), chars, symbols, len(lines) - len(set(lines)), len(repeated), failed, not failed and not bad,
        [round(s, 9) for s in shares],
    )


def personal(text):
    text = text or ""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        luhn = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits)))
        if 14 <= len(digits) <= 19 and luhn % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda x: (x[1], ["email", "ip", "card", "phone"].index(x[0])))


def secrets(text):
    text = text or ""
    out = []
    words = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    for m in re.finditer(rf"({words})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m[2]) >= 6:
            out.append(("assign", *m.span()))
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda x: (x[1], ["assign", "access", "hex"].index(x[0])))


def joined(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def shared_lines(rows, min_chars=40, min_texts=5):
    """{index: (n_lines, n_dropped, kept text)} of (key, text) rows."""
    key_of = lambda line: line.strip(SPACES).translate(LOWER)
    holders = defaultdict(set)
    for key, text in rows:
        for line in (text or "").split("\n"):
            if len(key_of(line)) >= min_chars:
                holders[key_of(line)].add(key)
    out = []
    for key, text in rows:
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            keys = holders.get(key_of(line), ())
            largest = max(keys, key=lambda k: (k is not None, k or 0)) if keys else None
            if len(keys) < min_texts or key == largest:
                kept.append(line)
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def shingles(text, width):
    words = [w.translate(LOWER) for w in WORD.findall(text or "")]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def groups(rows, width, percent=80):
    """{key: (n_shingles, component, kept)} of (key, text) rows with distinct keys."""
    sets = {k: shingles(t, width) for k, t in rows}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations([k for k in sets if sets[k]], 2):
        common = len(sets[a] & sets[b])
        if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {k: (len(s), find(k), find(k) == k) for k, s in sets.items()}


class KneserNey:
    """Interpolated modified Kneser-Ney bigrams from dictionaries."""

    END = ("end",)

    def __init__(self, texts):
        self.pairs = Counter()
        for t in texts:
            tokens = self.tokens(t)
            self.pairs.update(zip([None, *tokens], tokens))
        self.counts = Counter()
        self.before = Counter()
        self.after = defaultdict(list)
        for (h, w), c in self.pairs.items():
            self.counts[w] += c
            self.before[w] += 1
            self.after[h].append(c)
        self.d = self.discounts(self.pairs.values())
        self.e = self.discounts(self.before.values())
        self.n, self.v = sum(self.counts.values()), len(self.counts)

    @classmethod
    def tokens(cls, text):
        return [w.translate(LOWER) for w in WORD.findall(text or "")] + [cls.END]

    @staticmethod
    def discounts(counts):
        n = Counter(counts)
        if not (n[1] and n[2]):
            return [0, 0.5, 0.5, 0.5]
        y = n[1] / (n[1] + 2 * n[2])
        raw = [1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3] if n[3] else 2.5]
        return [0, *(min(max(d, 0), k) for k, d in enumerate(raw, 1))]

    def word(self, w):
        if not self.pairs:
            return 1 / (self.v + 1)
        left = sum(self.e[min(c, 3)] for c in self.before.values()) / len(self.pairs)
        return max(self.before[w] - self.e[min(self.before[w], 3)], 0) / len(self.pairs) + left / (self.v + 1)

    def chance(self, h, w):
        if h not in self.after:
            return self.word(w)
        total = sum(self.after[h])
        left = sum(self.d[min(c, 3)] for c in self.after[h]) / total
        return max(self.pairs[h, w] - self.d[min(self.pairs[h, w], 3)], 0) / total + left * self.word(w)

    def score(self, text):
        tokens = self.tokens(text)
        base = sum(math.log10((self.counts[w] + 1) / (self.n + self.v + 1)) for w in tokens)
        score = sum(math.log10(self.chance(h, w)) for h, w in zip([None, *tokens], tokens))
        return len(tokens), sum(self.counts[w] > 0 for w in tokens), base, score


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]
