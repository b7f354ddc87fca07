"""Windows of many texts compared side by side, against one text and window at a time."""

import functools
import itertools
import random
import re
import time

from textquarry.functions import nearness as N
from textquarry.operators import cleanup as K


def near_prefix(window, term, lengths, most):
    row = list(range(len(term) + 1))
    for i, c in enumerate(window, 1):
        new = [i]
        for j, t in enumerate(term, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (not N.alike(c, t))))
        row = new
        if i in lengths and row[-1] <= most:
            return True
    return False


@functools.cache
def shortened(term):
    n = len(term)
    letters = {c for own in (*N.ALIKE, *N.ALIKE.values(), term) for c in own}
    like = lambda c: "[" + "".join(re.escape(x) for x in sorted(letters) if N.alike(x, c)) + "]"
    forms = {"".join(w) for way in (term, term[::-1]) for w in itertools.combinations(way, max(5, n - 3, int(n * 0.65)))}
    return re.compile("|".join("".join(map(like, f)) for f in sorted(forms)))


def plain(sign, term):
    n = len(term)
    if n < 5:
        return term in sign or term[::-1] in sign
    edits, slack = next(((e, s) for top, e, s in N.SLACK if n <= top), (3, 2))
    for target, most in [(term, edits)] + ([(term[:-1], min(1, edits))] if n >= 7 else []):
        lengths = range(max(4, len(target) - slack), len(target) + slack + 1)
        if any(N.alike(sign[i], target[0]) and near_prefix(sign[i : i + lengths[-1]], target, lengths, most) for i in range(len(sign))):
            return True
    return n >= 7 and shortened(term).search(sign) is not None


def slips(rng, term, n):
    out = list(term)
    for _ in range(n):
        k = rng.randrange(len(out) + 1)
        out[k : k + rng.randrange(2)] = rng.choice(["", "", rng.choice("aeiouwvyst"), "x"])
    return "".join(out)


def test_windows_as_one_by_one(monkeypatch):
    rng, seen = random.Random(3), set()
    monkeypatch.setattr(N, "PORTION", 300)  # texts are joined, and long ones cut
    for term in ("sun", "trash", "family", "worthiess", "disgusting", "stranieriößж"):
        noise = lambda: "".join(rng.choice(term + "aeiouwvyg") for _ in range(rng.randrange(20)))
        texts = [noise() + (slips(rng, term, rng.randrange(6))[:: rng.choice((1, -1))]) + noise() for _ in range(400)]
        texts += ["", term, "".join(noise() for _ in range(80)) + slips(rng, term, 2), *(t + t[::-1] for t in texts[:100])]
        want = [plain(t, term) for t in texts]
        assert N.hold_nearly(enumerate(texts), term, len(texts)).tolist() == want
        both = [t + t[::-1] for t in texts]
        assert N.hold_nearly(enumerate(both), term, len(both), mirrored=True).tolist() == [plain(t, term) for t in both]
        seen |= set(want)
    assert seen == {True, False}


def test_long_text_is_read_in_linear_time():
    """A text of a million letters: some hundred forms of a term tried at each place took minutes."""
    rng = random.Random(5)
    text = "".join(rng.choices("etaoinshrdlucmfwypvbgkqjxz", weights=range(26, 0, -1), k=1_000_000)).replace("dis", "")
    begun = time.monotonic()
    N.hold_nearly([(0, text)], "disgusting", 1)
    assert time.monotonic() - begun < 3


def test_tokens_of_a_portion_are_matched_at_once():
    """Some thousand distinct tokens against two hints."""
    rng = random.Random(7)
    tokens = list({"".join(rng.choices("trashwolei", k=rng.randrange(4, 13))) for _ in range(4000)})
    found = K._hint_matcher(["trash", "worthless"])(tokens)
    for token in tokens:
        sign = token.replace("l", "i")
        want = next((h for f, h in (("trash", "trash"), ("worthiess", "worthless")) if sign in (f, f[::-1]) or abs(len(sign) - len(f)) <= 3 and plain(sign, f)), None)
        assert found.get(token) == want
