"""Tokens that a service makes without seeing the values, and a linear score on encrypted features.

Demonstrations of the protocols in plain Python numbers: random factors come from seeds, so that lost tasks repeat them."""

from __future__ import annotations

import hashlib
import random

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .crossbank import Paillier, leakage_checks

#: The curve secp256k1 (prime, order, a * x is absent, b = 7).
P = 0xFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFEFFFFFC2F
ORDER = 0xFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFEBAAEDCE6AF48A03BBFD25E8CD0364141


def add(a, b):
    """Sum of two points; None is the point at infinity."""
    if a is None or b is None:
        return a or b
    if a[0] == b[0] and (a[1] + b[1]) % P == 0:
        return None
    slope = 3 * a[0] * a[0] * pow(2 * a[1], -1, P) if a == b else (b[1] - a[1]) * pow(b[0] - a[0], -1, P)
    x = (slope * slope - a[0] - b[0]) % P
    return x, (slope * (a[0] - x) - a[1]) % P


#: Fixed values of the curve: LAMBDA times a point is (BETA * x, y); and two short vectors (a, b) with a + b * LAMBDA = 0.
BETA = 0x7AE96A2B657C07106E64479EAC3434E99CF0497512F58995C1396C28719501EE
A1, B1 = 0x3086D221A7D46BCDE86C90E49284EB15, -0xE4437ED6010E88286F547FA90ABFE4C3
A2, B2 = 0x114CA50F7A8E2F3F657C1108D9D44CFD8, A1


def _halves(k: int) -> tuple[int, int]:
    """Two numbers of half the length, of either sign, with first + second * LAMBDA = k."""
    c1, c2 = (B2 * k + ORDER // 2) // ORDER, (-B1 * k + ORDER // 2) // ORDER
    return k - c1 * A1 - c2 * A2, -c1 * B1 - c2 * B2


def _digits(k: int) -> list[int]:
    """Signed binary digits from the lowest on: 0 or odd, -7 to 7, three zeros at least after each."""
    sign, k, out = (-1 if k < 0 else 1), abs(k), []
    while k:
        d = (k & 15) - 16 * (k & 15 > 7) if k & 1 else 0
        out.append(sign * d)
        k = (k - d) >> 1
    return out


def times(k: int, point):
    """The multiple of a point: both halves of k in one run of doublings, without a division until the end."""
    k %= ORDER
    if point is None or not k:
        return None
    odd, twice = [point], add(point, point)
    while len(odd) < 4:
        odd.append(add(odd[-1], twice))
    plain = {d: q for i, (x, y) in enumerate(odd) for d, q in ((2 * i + 1, (x, y)), (-2 * i - 1, (x, P - y)))}
    turned = {d: (BETA * x % P, y) for d, (x, y) in plain.items()}
    first, second = map(_digits, _halves(k))
    x, y, z = 0, 1, 0  # x / z^2 and y / z^3; infinity if z is 0
    for i in range(max(len(first), len(second)) - 1, -1, -1):
        if z:
            b = y * y % P
            d, e = 4 * x * b % P, 3 * x * x % P
            x, z = (e * e - 2 * d) % P, 2 * y * z % P
            y = (e * (d - x) - 8 * b * b) % P
        for digits, table in ((first, plain), (second, turned)):
            if i < len(digits) and digits[i]:
                x, y, z = _plus(x, y, z, *table[digits[i]])
    if not z:
        return None
    i = pow(z, -1, P)
    return x * i * i % P, y * i * i * i % P


def _plus(x: int, y: int, z: int, u: int, v: int) -> tuple[int, int, int]:
    """(x, y, z) and the point (u, v)."""
    if not z:
        return u, v, 1
    square = z * z % P
    h, r = (u * square - x) % P, (v * square * z - y) % P
    if not h:  # the same point, or its opposite
        same = add((u, v), (u, v)) if not r else None
        return (*same, 1) if same else (0, 1, 0)
    hh = h * h % P
    hhh, w = h * hh % P, x * hh % P
    new = (r * r - hhh - 2 * w) % P
    return new, (r * (w - new) - y * hhh) % P, z * h % P


def to_curve(value: str):
    """The first point whose x is a hash of the value and a counter."""
    n = 0
    while True:
        x = int.from_bytes(hashlib.sha256(f"{n}|{value}".encode()).digest()) % P
        square = (x**3 + 7) % P
        y = pow(square, (P + 1) // 4, P)
        if y * y % P == square:
            return x, min(y, P - y)
        n += 1


def token_of(point) -> str:
    return hashlib.sha256(point[0].to_bytes(32) + point[1].to_bytes(32)).hexdigest()[:32]


def blinded_tokens(values: DataFrame, column: str, key: int, seed: str = "blind", most: int | None = None) -> DataFrame:
    """Distinct values and their tokens, in three steps: the holder blinds, the service applies its key to what
    it can't read, the holder unblinds. Each is a pass over rows; the service's step gets blinded points alone.

    The service evaluates ``most`` values at most, if given; more raise PermissionError before any is evaluated."""
    return _blinded(values, column, key, seed, most)[0]


def _blinded(values: DataFrame, column: str, key: int, seed: str, most: int | None) -> tuple[DataFrame, DataFrame]:
    """The tokens, and the points that the service received (x, y)."""

    def factor(value: str) -> int:
        return random.Random(f"{seed}|{value}").randrange(1, ORDER)

    def blind(batches):
        for b in batches:
            points = [times(factor(v), to_curve(v)) for v in b["value"]]
            yield pd.DataFrame({"value": b["value"], "x": [f"{p[0]:x}" for p in points], "y": [f"{p[1]:x}" for p in points]})

    def evaluate(batches):
        for b in batches:
            points = [times(key, (int(x, 16), int(y, 16))) for x, y in zip(b["x"], b["y"], strict=True)]
            yield pd.DataFrame({"bx": b["x"], "x": [f"{p[0]:x}" for p in points], "y": [f"{p[1]:x}" for p in points]})

    def unblind(batches):
        for b in batches:
            rows = zip(b["value"], b["x"], b["y"], strict=True)
            yield pd.DataFrame({"value": b["value"], "token": [token_of(times(pow(factor(v), -1, ORDER), (int(x, 16), int(y, 16)))) for v, x, y in rows]})

    # Big-number work: few bytes, long tasks, so the number of partitions is stated and stays.
    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mine = values.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("value")).distinct().repartition(parts, "value").mapInPandas(blind, "value string, x string, y string")
    mine = checkpointed(mine)
    if most is not None and mine.count() > most:
        raise PermissionError(f"the service evaluates {most} values at most")
    served = mine.select("x", "y").mapInPandas(evaluate, "bx string, x string, y string")
    tokens = mine.select("value", F.col("x").alias("bx")).join(served, "bx").select("value", "x", "y").mapInPandas(unblind, "value string, token string").withColumnRenamed("value", column)
    return tokens, mine.select("x", "y")


def leakage_report(values: DataFrame, column: str, key: int, guess: int, seed: str = "blind") -> DataFrame:
    """``crossbank.leakage_checks`` of one run over the values: what the hub got (tokens), what the service got (points), and
    what someone who knows all values gets back with a guessed key."""
    tokens, received = _blinded(values, column, key, seed, None)
    known = values.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("value")).distinct()

    def points(batches):
        for b in batches:
            yield pd.DataFrame({"point": [f"{to_curve(v)[0]:x}" for v in b["value"]], "token": [token_of(times(guess, to_curve(v))) for v in b["value"]]})

    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tried = checkpointed(known.repartition(parts, "value").mapInPandas(points, "point string, token string"))
    return leakage_checks(tokens.select("token"), known, received.select(F.col("x").alias("point")), tried.select("point"), tried.select("token"))


def encrypted_score(rows: DataFrame, key_column: str, weights: dict[str, float], intercept: float, bits: int = 3072, seed: int = 1, scale: int = 1 << 40, whole_bits: int = 31) -> DataFrame:
    """``key_column`` and ``logit``: a linear score from encrypted features, fixed point with 40 binary digits.

    The holder encrypts its features, the scorer raises ciphertexts to its weights and multiplies them, the
    holder decrypts. A null feature counts as 0. Weights are the same for all rows, so a ciphertext holds a column of several
    rows, each in digits of its own that its logit can't leave; a row with a feature of ``whole_bits`` bits or more before the
    point has ciphertexts of its own."""
    key, columns = Paillier(bits, seed), list(weights)
    fixed, shift = [round(weights[c] * scale) for c in columns], round(intercept * scale * scale)
    most = scale << whole_bits
    width = (sum(map(abs, fixed)) * most + abs(shift)).bit_length() + 1
    slots = max(1, (key.n.bit_length() - 2) // width)
    kind = rows.schema[key_column].dataType.simpleString()

    def encrypt(batches):
        for b in batches:
            keys = b[key_column].tolist()
            values = [[round((0.0 if pd.isna(v) else v) * scale) for v in b[c].tolist()] for c in columns]
            wide = {i for i in range(len(keys)) if any(abs(x[i]) >= most for x in values)}
            packed = [i for i in range(len(keys)) if i not in wide]
            groups = [packed[i : i + slots] for i in range(0, len(packed), slots)] + [[i] for i in sorted(wide)]
            out = {"keys": [[keys[i] for i in g] for g in groups]}
            for c, x in zip(columns, values, strict=True):
                out[c] = [f"{key.seal(sum(x[i] << (width * k) for k, i in enumerate(g)) % key.n, f'{seed}|{keys[g[0]]}|{c}'):x}" for g in groups]
            yield pd.DataFrame(out)

    def score(batches):
        for b in batches:
            out = []
            for keys, *row in zip(b["keys"], *[b[c] for c in columns], strict=True):
                total, under = key.encrypt(sum(shift << (width * k) for k in range(len(keys))) % key.n, 1), 1
                for w, c in zip(fixed, row, strict=True):
                    if w >= 0:
                        total = total * pow(int(c, 16), w, key.square) % key.square
                    else:
                        under = under * pow(int(c, 16), -w, key.square) % key.square
                out.append(f"{total * pow(under, -1, key.square) % key.square:x}")
            yield pd.DataFrame({"keys": b["keys"], "cipher": out})

    def decrypt(batches):
        half = 1 << (width - 1)
        for b in batches:
            out = {key_column: [], "logit": []}
            for keys, c in zip(b["keys"], b["cipher"], strict=True):
                m = key.decrypt(int(c, 16))
                m = m - key.n if m > key.n // 2 else m
                for _ in range(len(keys) - 1):
                    low = (m + half) % (2 * half) - half
                    out["logit"].append(low / scale**2)
                    m = (m - low) >> width
                out["logit"].append(m / scale**2)
                out[key_column] += list(keys)
            yield pd.DataFrame(out)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(key_column, *[F.col(c).cast("double") for c in columns]).repartition(parts, key_column).sortWithinPartitions(key_column)
    ciphers = dealt.mapInPandas(encrypt, f"keys array<{kind}>, " + ", ".join(f"{c} string" for c in columns))
    return ciphers.mapInPandas(score, f"keys array<{kind}>, cipher string").mapInPandas(decrypt, f"{key_column} {kind}, logit double")
