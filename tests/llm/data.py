"""Small texts with copies, near copies, shared passages, repeated lines, secrets, empty and null texts."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows(n=120, seed=3):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgh éüß") for _ in range(r.randint(1, 7))).strip() or "a" for _ in range(150)]
    words = lambda k: [r.choice(vocabulary) for _ in range(k)]
    passage, line = " ".join(words(60)), "A common line: " + " ".join(words(6))
    out = []
    for i in range(n):
        w = words(r.choice([0, 1, 2, 3, 9, 40, 150, 400]))
        t = " ".join(w).replace("a b", "a\nb")
        kind = r.random()
        if kind < 0.15 and out:
            t = r.choice(out)[1]
        elif kind < 0.45 and out:
            o = (r.choice(out)[1] or "").split(" ")
            for _ in range(max(1, len(o) // 40)):
                o[r.randrange(len(o))] = r.choice(vocabulary)
            t = " ".join(o)
        elif kind < 0.6:
            t = (t or "") + "\n" + passage + "\n" + " ".join(words(5))
        if t is not None and r.random() < 0.3:
            t = t + "\n  " + (line.upper() if r.random() < 0.5 else line) + "\t"
        if r.random() < 0.2:
            t = (t or "") + r.choice([' password = "abcDEF123456"', " token:short", " AKIA" + "Z9" * 8, " deadbeef00112233ff", "  api_key=sk.0123456789abcdef end", "x  <|endoftext|>  y"])
        out.append((i * 3 + 1, r.choice([t, t, t, t, t, t, t, None, ""]) if kind > 0.9 else t, "en", f"src{i % 4}", len(t or "")))
    out.append((n * 3 + 5, "aaaa " * 300 + "a" * 200, "en", None, 0))
    out.append((n * 3 + 6, "aaaa " * 290 + "b" * 90 + "日本語 １２３" * 20, None, "src1", None))
    r.shuffle(out)
    return out
