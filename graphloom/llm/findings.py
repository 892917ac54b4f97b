"""Labelled findings that the secret scanner's network is trained on: values of many kinds, made by rule, in made-up context.

Secrets are what issuers and password rules make: random letters of some alphabet, with or without prefix and frame. The others are what looks
alike in texts and is none: numbers, addresses, identifiers, names of files. A seed gives the same findings each time.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
from pyspark import cloudpickle

LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ALNUM = LOWER + UPPER + DIGITS
ACCENTS = str.maketrans("aeiou", "áéíöü")


class Maker:
    """Random parts of values."""

    def __init__(self, seed: int) -> None:
        self.rng = np.random.default_rng(seed)

    def pick(self, choices):
        return choices[int(self.rng.integers(len(choices)))]

    def run(self, letters: str, low: int, high: int) -> str:
        return "".join(letters[i] for i in self.rng.integers(0, len(letters), int(self.rng.integers(low, high + 1))))

    def word(self, low: int = 1, high: int = 3) -> str:
        return "".join(self.pick("bcdfghklmnprstvw") + self.pick("aeiou") + self.pick(["", "", "n", "r", "s", "t"]) for _ in range(int(self.rng.integers(low, high + 1))))

    def number(self, low: int, high: int) -> str:
        return str(int(self.rng.integers(low, high)))

    def joined(self, sep: str, low: int, high: int) -> str:
        return sep.join(self.word() for _ in range(int(self.rng.integers(low, high + 1))))

    def prose(self, low: int, high: int) -> str:
        """Words, of which some have letters beyond ASCII, as most languages do."""
        text = self.joined(" ", low, high)
        return text.translate(ACCENTS) if self.rng.random() < 0.4 else text

    def password(self) -> str:
        value = list(self.run(LOWER, 3, 6) + self.run(UPPER, 1, 3) + self.run(DIGITS, 2, 4) + self.run("!@#$%^&*-+?", 1, 3))
        self.rng.shuffle(value)
        return "".join(value)


SECRETS: dict[str, Callable[[Maker], str]] = {
    "vendor": lambda m: m.run(LOWER, 2, 5) + m.pick("_-") + m.pick(["", "live_", "v1-"]) + m.run(ALNUM, 20, 40),
    "base64": lambda m: m.run(ALNUM + "+/", 38, 64) + m.pick(["", "=", "=="]),
    "mixed": lambda m: m.run(ALNUM, 20, 48),
    "capitals": lambda m: m.run(UPPER, 4, 4) + m.run(UPPER + DIGITS, 12, 28),
    "password": lambda m: m.password(),
    "connection": lambda m: f"{m.word()}://{m.word()}:{m.pick([m.password, lambda: m.run(ALNUM, 10, 20)])()}@{m.word()}.{m.word()}:{m.number(1000, 9999)}/{m.word()}",
    "signed": lambda m: ".".join(["eyJ" + m.run(ALNUM, 14, 30), "eyJ" + m.run(ALNUM + "-_", 30, 60), m.run(ALNUM + "-_", 30, 43)]),
    "capital_hex": lambda m: m.run("0123456789ABCDEF", 32, 64),
    "letters": lambda m: m.run(LOWER + UPPER, 24, 40),
    "small": lambda m: m.run(LOWER + DIGITS, 24, 40),
}

OTHERS: dict[str, Callable[[Maker], str]] = {
    "card": lambda m: m.run(DIGITS, 12, 19),
    "address": lambda m: ".".join(m.number(0, 256) for _ in range(4)),
    "mail": lambda m: f"{m.joined('.', 1, 2)}{m.number(1, 99)}@{m.word()}{m.number(1, 9)}.{m.pick(['com', 'org', 'net'])}",
    "uuid": lambda m: "-".join(m.run("0123456789abcdef", n, n) for n in (8, 4, 4, 4, 12)),
    "date": lambda m: f"{m.number(1900, 2100)}-{m.run('01', 2, 2)}-{m.run('012', 2, 2)}T{m.run('012', 2, 2)}:{m.number(10, 60)}:{m.number(10, 60)}Z",
    "version": lambda m: f"{m.word()}-{m.number(0, 30)}.{m.number(0, 20)}.{m.number(0, 99)}{m.pick(['', '-beta1', '-rc2'])}",
    "link": lambda m: f"https://{m.joined('.', 1, 2)}.com/{m.joined('/', 1, 3)}/{m.joined('-', 1, 4)}-{m.number(1, 9999)}",
    "path": lambda m: f"/{m.joined('/', 2, 5)}/{m.joined('_', 1, 2)}{m.number(1, 99)}.{m.pick(['py', 'txt', 'csv', 'jpg'])}",
    "camel": lambda m: m.word() + "".join(m.word().capitalize() for _ in range(int(m.rng.integers(1, 4)))) + m.pick(["", m.number(1, 99)]),
    "snake": lambda m: m.joined(m.pick("_-"), 2, 4) + m.pick("_-") + m.number(1, 9999),
    "phone": lambda m: f"+{m.number(1, 99)}-{m.number(100, 999)}-{m.number(100, 999)}-{m.number(1000, 9999)}",
    "amount": lambda m: f"{m.number(1, 999)},{m.number(100, 999)},{m.number(100, 999)}.{m.number(10, 99)}",
    "order": lambda m: f"{m.word().upper()}-{m.number(2000, 2030)}-{m.run(DIGITS, 4, 8)}",
    "word": lambda m: m.word(2, 4) + m.number(1, 9999),
    "compound": lambda m: m.word(8, 12),
    "shout": lambda m: m.word(3, 5) + m.pick(["!!", "%%%", "###", "***"]) + m.number(1, 99),
}


#: Kinds that are told apart least easily are made so many times as often.
OFTEN = {"password": 3, "camel": 2, "mail": 2, "card": 2}


def findings(per_kind: int, seed: int = 5) -> list[tuple[str, int, str, int, int]]:
    """(kind, label, text, start, end): ``per_kind`` values of each kind, or a multiple, half of them behind a telling word; signs follow some that are no secrets."""
    m, out = Maker(seed), []
    for label, kinds in ((1, SECRETS), (0, OTHERS)):
        told = ["key: ", "Bearer ", "pw is ", "auth=", "credential ", "login with "] if label else ["see ", "no. ", "id: ", "from ", "file ", "host="]
        for kind, make in kinds.items():
            for _ in range(per_kind * OFTEN.get(kind, 1)):
                before = m.prose(1, 6) + m.pick([" ", ". ", "\n", ', "', " | "]) + (m.pick(told) if m.rng.random() < 0.5 else "")
                value = make(m) + (m.pick("!#$%&*?~") * int(m.rng.integers(1, 4)) if not label and m.rng.random() < 0.3 else "")
                out.append((kind, label, before + value + m.pick([" ", ".", '" ', "\n", " | "]) + m.prose(1, 4), len(before), len(before) + len(value)))
    return out


cloudpickle.register_pickle_by_value(sys.modules[__name__])
