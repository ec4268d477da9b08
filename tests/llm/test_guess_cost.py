"""The guess cost is the least over all segmentations."""

import random
import time

import pytest

from lastrum.llm import secrets
from lastrum.llm.secrets import DATE_COST, PART_COST, STEP_COST, WALK_COST, YEAR_COST, coster

WORDS = ["house", "river", "aba", "qwe"]


def date_cost(part):
    """By taking the digits one field after the other; None if the part is no date."""
    for form in ("ymd", "dmy", "y"):
        rest, ok = part, True
        for k, field in enumerate(form):
            rest = rest[1:] if k and rest[:1] in tuple("-/._") else rest
            size, low, high = {"y": (4, 1900, 2099), "m": (2, 1, 12), "d": (2, 1, 31)}[field]
            digits, rest = rest[:size], rest[size:]
            ok = ok and len(digits) == size and all(c in "0123456789" for c in digits) and low <= int(digits) <= high
        if ok and not rest:
            return YEAR_COST if form == "y" else DATE_COST
    return None


def brute(value):
    """By trying every part between every two places."""
    ranks = {w: i + 1 for i, w in enumerate(WORDS)}
    ranks |= {w: min(i + 1, ranks.get(w, i + 1)) for i, w in enumerate(secrets.WORDS)}
    low = value.lower()
    plain = low.translate(secrets._LEET)
    best = [0.0]
    for j in range(1, len(value) + 1):
        costs = []
        for i in range(j):
            part = value[i:j]
            if j - i == 1:
                costs.append(best[i] + secrets._brute(part))
            if j - i >= 3 and plain[i:j] in ranks:
                costs.append(best[i] + secrets.word_cost(part, low[i:j], plain[i:j], ranks[plain[i:j]]))
            if date := date_cost(part):
                costs.append(best[i] + PART_COST + date)
            if j - i >= 3 and all(x in secrets._NEXT for x in zip(low[i:j], low[i + 1 : j])):
                costs.append(best[i] + PART_COST + WALK_COST + STEP_COST * (j - i))
            if low[i:j] in low[: j - 1]:
                costs.append(best[i] + secrets.repeat_cost(j))
        best.append(min(costs))
    return best[-1]


@pytest.mark.parametrize("letters", ["ab", "qwertyasdf", "1290-/7", "abqweHOUSEriver19870605p4ssw0rd"])
def test_least_over_all_segmentations(letters):
    rnd, cost = random.Random(letters), coster(WORDS)
    parts = [*WORDS, *secrets.WORDS[:9], "1987-06-05", "2001", "Tyuio", "p4ssw0rd", "789", "Kq7!"]
    for _ in range(400):
        value = "".join(rnd.choice(parts) if rnd.random() < 0.3 else rnd.choice(letters) for _ in range(rnd.randrange(1, 25)))
        wanted = brute(value)
        assert cost(value) == pytest.approx(wanted), value
        for enough in (2.0, 5.0, 8.0):  # stopping early never changes what is reported
            assert (cost(value, enough) >= enough - 1e-9) == (wanted >= enough - 1e-9), value


def test_dates_in_all_lengths():
    rnd, cost = random.Random("dates"), coster(WORDS)
    parts = ["2024", "20240101", "01012020", "1999", "31.12.1999", "2001-02-03", "0", "12", "19", "20", "-", "changeme", "river"]
    for _ in range(2000):
        value = "".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 5)))
        assert cost(value) == pytest.approx(brute(value)), value
    assert cost("01012020changeme20240101") == pytest.approx(brute("01012020changeme20240101")) and cost("01012020changeme20240101") < 10.9


def test_walks_and_repeats_of_any_place_and_length():
    cost = secrets.guess_cost
    assert cost("whatevertyuio") < 5
    unit = "Zk3vQ9xLm2Wp"
    assert cost(unit) > 14 and cost(unit * 2) < cost(unit) + 2 and cost(unit * 30) < cost(unit) + 3.5


@pytest.mark.parametrize("unit", ["a", "ab", "qwerty", "Zk3vQ9xLm2", "password"])
def test_long_values_in_linear_time(unit):
    began = time.perf_counter()
    secrets.guess_cost(unit * (100_000 // len(unit)))
    assert time.perf_counter() - began < 20


def test_a_megabyte_of_random_text_stops_early():
    rnd = random.Random(1)
    value = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyzABCDEFGH0123456789+/") for _ in range(1_000_000))
    began = time.perf_counter()
    assert [k for _, k, _ in secrets.spans(f"token={value}")] == [0, 3] and time.perf_counter() - began < 5
