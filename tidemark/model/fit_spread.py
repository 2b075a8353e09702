"""The estimator of `fit_many` for scopes whose pairings and teams outgrow one task.

Teams are dealt over places by a hash, and a pairing lies at the place of its home team. A sweep is two shuffles: every place
sends its teams' ratings to the places that host them, and those send back each visitor's sums. All ratings of a sweep move
from the same point (Jacobi), and the sweeps are mixed over the last few (Anderson), so their number hardly grows with the
scope. The driver sees a fixed number of sums per fit and place, never a rating.

Pairings, subscriptions and ratings are written as one row of packed arrays a place, dealt by place, so a sweep shuffles
the messages and the new ratings alone. A place's rows hold about `PLACE_MATCHES` matches, however large the scope is.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.model.profiles import Config
from tidemark.session import ensure_checkpoint_dir

DAY_US = 86_400_000_000
PLACE_MATCHES = 250_000
MIXED = 4  # earlier sweeps that the next point is mixed from

FIT = ["scope", "cutoff"]
PLACE = [*FIT, "place"]
MESSAGES = "array<struct<place:int,source:int,payload:binary>>"


def _floats(data, *shape: int, kind=np.float64) -> np.ndarray:
    return np.frombuffer(data, dtype=kind).reshape(shape)


def _at(data) -> np.ndarray:
    return np.frombuffer(data, dtype=np.int32)


def _deal(cells: DataFrame, halves: Sequence[float | None], cutoffs: DataFrame, places: int, parts: int) -> DataFrame:
    """A row a pairing and fit with flat sums and one weighted sum a half-life, dealt by place."""

    def place(team: str):
        return F.pmod(F.xxhash64(team), F.lit(places)).cast("int")

    def aged(half_life):
        return F.lit(1.0) if half_life is None else F.pow(F.lit(0.5), (F.col("cutoff") - F.col("k")) / F.lit(float(DAY_US)) / F.lit(half_life))

    seen = cells.join(F.broadcast(cutoffs), "scope").filter("k < cutoff").withColumn("place", place("home"))
    sums = [F.sum(c).alias(c) for c in ("n", "hg", "ag", "lg")]
    sums += [F.sum(F.col(c) * aged(h)).alias(f"{c}{i}") for i, h in enumerate(halves) for c in ("wn", "wh", "wa")]
    return seen.repartition(parts, *PLACE).groupBy(*PLACE, "home", "away").agg(*sums).withColumn("there", place("away"))


def _placed(pairs: DataFrame, halves: int, parts: int) -> DataFrame:
    """A row a fit and place: its teams with their sums, its pairings, and who asks for which of its teams.

    Sums a team: matches, goals scored and conceded, then scored and conceded weighted for each half-life.
    """
    team = pairs.schema["home"].dataType.simpleString()
    key = f"scope {pairs.schema['scope'].dataType.simpleString()}, cutoff bigint, place int"
    edges = "own binary, guest binary, mass binary, met binary, ends array<struct<place:int,n:int>>, totals array<double>"

    def indexed(pdf: pd.DataFrame) -> pd.DataFrame:
        scope, cutoff, place = pdf[PLACE].iloc[0]
        hosts, own = np.unique(pdf.home.to_numpy(), return_inverse=True)
        guests, guest = np.unique(pdf.away.to_numpy(), return_inverse=True)
        there = np.zeros(len(guests), dtype=np.int32)
        there[guest] = pdf.there.to_numpy()
        order = np.argsort(there, kind="stable")
        turned = np.empty_like(order)
        turned[order] = np.arange(len(order))
        guests, there, guest = guests[order], there[order], turned[guest]

        def sums(code, size, scored, conceded):
            names = ["n", scored, conceded, *[f"w{c[0]}{i}" for i in range(halves) for c in (scored, conceded)]]
            return np.stack([np.bincount(code, pdf[c].to_numpy(), size) for c in names])

        at_home, away = sums(own, len(hosts), "hg", "ag"), sums(guest, len(guests), "ag", "hg")
        ends, starts, counts = np.unique(there, return_index=True, return_counts=True)
        rows = [{
            "place": place, "source": -1, "teams": list(hosts), "sums": at_home.tobytes(), "own": own.astype(np.int32).tobytes(),
            "guest": guest.astype(np.int32).tobytes(), "mass": pdf[[f"wn{i}" for i in range(halves)]].to_numpy(dtype=float).T.tobytes(),
            "met": pdf.n.to_numpy(dtype=float).tobytes(), "ends": [{"place": int(e), "n": int(c)} for e, c in zip(ends, counts)],
            "totals": pdf[totals].sum().tolist(),
        }]
        rows += [
            none | {"place": e, "source": place, "teams": list(guests[s:s + c]), "sums": away[:, s:s + c].tobytes()}
            for e, s, c in zip(ends, starts, counts)
        ]
        return pd.DataFrame(rows, columns=columns).assign(scope=scope, cutoff=cutoff)[["scope", "cutoff", *columns]]

    columns = ["place", "source", "teams", "sums", "own", "guest", "mass", "met", "ends", "totals"]
    totals = ["n", "lg", "hg", "ag", *[f"{c}{i}" for c in ("wn", "wh", "wa") for i in range(halves)]]
    none = {"own": b"", "guest": b"", "mass": b"", "met": b"", "ends": [], "totals": [0.0] * len(totals)}
    dealt = pairs.groupBy(*PLACE).applyInPandas(
        indexed, f"{key}, source int, teams array<{team}>, sums binary, {edges}"
    )

    def settled(pdf: pd.DataFrame) -> pd.DataFrame:
        teams = np.unique(np.concatenate([np.asarray(t) for t in pdf.teams]))
        sums = np.zeros((3 + 2 * halves, len(teams)))
        out = dict(zip(PLACE, pdf[PLACE].iloc[0])) | none | {"asked": []}
        for row in pdf.itertuples(index=False):
            at = np.searchsorted(teams, np.asarray(row.teams)).astype(np.int32)
            sums[:, at] += _floats(row.sums, 3 + 2 * halves, len(at))
            if row.source < 0:
                out |= {"own": at[_at(row.own)].tobytes(), **{c: getattr(row, c) for c in ("guest", "mass", "met", "ends", "totals")}}
            else:
                out["asked"].append({"place": int(row.source), "at": at.tobytes()})
        return pd.DataFrame([out | {"teams": list(teams), "sums": sums.tobytes()}])[order]

    order = [*PLACE, "teams", "sums", "asked", "own", "guest", "mass", "met", "ends", "totals"]
    schema = f"{key}, teams array<{team}>, sums binary, asked array<struct<place:int,at:binary>>, {edges}"
    return dealt.groupBy(*PLACE).applyInPandas(settled, schema).repartition(parts, *PLACE)


class _Point:
    """Where one fit stands, as the driver knows it: level, home edge and how the next point is mixed, per half-life."""

    def __init__(self, totals: np.ndarray, halves: int):
        # matches, log factorials, home and away goals, then weighted matches, home and away goals of each half-life
        self.matches, self.lg, self.flat_home, flat_away = totals[:4]
        self.mass, self.home, away = totals[4:].reshape(3, halves)
        self.flat_goals, self.goals = self.flat_home + flat_away, self.home + away
        self.usable = (self.flat_goals > 0) & (self.goals > 0)
        self.live = self.usable.copy()
        self.mu = np.log(np.where(self.usable, self.goals, 1.0) / (2.0 * np.where(self.usable, self.mass, 1.0)))
        self.ha = np.zeros(halves)
        self.sweeps, self.converged = np.zeros(halves, dtype=int), np.zeros(halves, dtype=bool)
        self.means = np.zeros((halves, 2))
        self.share, self.kept = np.ones(halves), [None] * halves
        self.shift = np.zeros((halves, 2))
        self.past: list[list] = [[] for _ in range(halves)]
        self.last: list = [None] * halves
        self.best, self.final = np.full(halves, np.inf), False
        self.out_mu, self.out_ha = self.mu.copy(), self.ha.copy()

    def told(self) -> dict:
        """What the tasks of a sweep need of it."""
        return {"mu": self.mu.copy(), "ha": self.ha.copy(), "live": self.live.copy(), "share": self.share.copy(), "kept": list(self.kept),
                "shift": -self.means if self.final else self.shift.copy(), "final": self.final}

    def learn(self, stats: list[np.ndarray], config: Config) -> None:
        """`stats`: per half-life (places, numbers) of one sweep, see `_moved`."""
        for h in np.flatnonzero(self.live):
            told, q = stats[h], min(len(self.past[h]) + (self.last[h] is not None), MIXED)
            rate_home, rate_away = told[:, 0].sum(), told[:, 1].sum()
            mean = told[:, 3:5].sum(0) / told[:, 2].sum()
            moved = np.maximum(np.abs(told[:, 5:7].max(0) - mean), np.abs(told[:, 7:9].min(0) - mean)).max()
            mu = self.mu[h] + np.log(self.goals[h] / (np.exp(self.mu[h]) * (np.exp(self.ha[h]) * rate_home + rate_away)))
            expected = np.exp(mu + self.ha[h]) * rate_home
            ha = self.ha[h] + (np.log(self.home[h] / expected) if self.home[h] > 0 and expected > 0 else 0.0)
            step = np.array([mu + mean[0] - mean[1] - self.mu[h], ha - self.ha[h]])
            moved = max(moved, np.abs(step).max())
            here = np.array([self.mu[h], self.ha[h]])
            if self.last[h] is not None:
                was, was_step, was_mean = self.last[h]
                self.past[h] = [*self.past[h], (here - was, step - was_step, mean - was_mean)][-MIXED:]
            self.last[h], self.means[h] = (here, step, mean), mean
            self.sweeps[h] += 1
            self.out_mu[h], self.out_ha[h] = here + step
            if moved < config.tolerance or self.sweeps[h] >= config.max_sweeps:
                self.converged[h], self.live[h] = moved < config.tolerance, False
                continue
            self.best[h] = min(self.best[h], moved)
            if moved > 1000.0 * self.best[h]:
                # The mixture led away: half a plain sweep from here, and what was kept is dropped.
                self.past[h], self.last[h], self.best[h], mixed, self.share[h] = [], None, np.inf, np.zeros(0), 0.5
            else:
                mixed, self.share[h] = self._mixed(h, told[:, 9:].sum(0), q, step, mean), 1.0
            self.kept[h] = mixed if self.last[h] is not None else None
            moves, steps, means = (np.array([p[i] for p in self.past[h]]).reshape(-1, 2) for i in range(3))
            self.shift[h] = -self.share[h] * mean + mixed @ means if len(mixed) else -self.share[h] * mean
            self.mu[h], self.ha[h] = here + self.share[h] * step - (mixed @ (moves + steps) if len(mixed) else 0.0)

    def _mixed(self, h: int, sums: np.ndarray, q: int, step: np.ndarray, mean: np.ndarray) -> np.ndarray:
        """Weights of the kept differences whose mixture leaves the least movement, each rating weighted by its goals."""
        size = q + 1
        gram, level = np.zeros((size, size)), np.array([self.goals[h], max(self.home[h], 1e-300)])
        scalars = np.stack([step, *[p[1] for p in self.past[h]]])
        means = np.stack([mean, *[p[2] for p in self.past[h]]])
        block = size * size + size + 1
        for side in range(2):
            raw = sums[side * block:(side + 1) * block]
            first, weight = raw[size * size:size * size + size], raw[-1]
            m = means[:, side]
            gram += raw[:size * size].reshape(size, size) - np.outer(first, m) - np.outer(m, first) + weight * np.outer(m, m)
        gram += (scalars * level) @ scalars.T
        if not q:
            return np.zeros(0)
        scale = np.sqrt(np.maximum(np.diag(gram)[1:], 1e-300))
        return np.linalg.lstsq(gram[1:, 1:] / np.outer(scale, scale), gram[1:, 0] / scale, rcond=1e-14)[0] / scale


def _advanced(told: dict, xs: np.ndarray, fs: np.ndarray) -> np.ndarray:
    """The next point, (halves, 2, teams), from the last points and their movements, newest last."""
    if told["final"]:
        return xs[-1] + fs[-1] + told["shift"][..., None]
    out = xs[-1].copy()
    for h in np.flatnonzero(told["live"]):
        out[h] += told["share"][h] * fs[-1, h] + told["shift"][h][:, None]
        kept = told["kept"][h]
        if kept is not None and len(kept):
            both = np.diff((xs + fs)[-len(kept) - 1:, h], axis=0)
            out[h] -= np.tensordot(kept, both, 1)
    return out


def _moved(told: dict, xs: np.ndarray, fs: np.ndarray, x: np.ndarray, met: np.ndarray, rates: np.ndarray, sums: np.ndarray, ridge: float):
    """The movement of a place's teams at `x`, and the numbers the driver mixes from.

    Numbers per half-life: both rates, teams, sums of the moved attacks and defences, largest and smallest movements, and for
    attacks and defences the products of movement and kept differences, their sums and the weights, each weighted by goals.
    """
    f, stats = fs[-1].copy(), []
    scored, conceded = sums[3::2], sums[4::2]
    for h, live in enumerate(told["live"]):
        if not live:
            stats.append([])
            continue
        level = np.exp(told["mu"][h])
        expected = level * np.exp(x[h, 0]) * met[h, 0]
        f[h, 0] = np.clip((scored[h] - expected - ridge * x[h, 0]) / (expected + ridge), -2.0, 2.0)
        expected = level * np.exp(-x[h, 1]) * met[h, 1]
        f[h, 1] = np.clip((expected - conceded[h] - ridge * x[h, 1]) / (expected + ridge), -2.0, 2.0)
        q = 0 if told["kept"][h] is None else min(len(told["kept"][h]) + 1, MIXED)
        steps = np.diff(np.concatenate([fs[:, h], f[None, h]])[-q - 1:], axis=0)
        numbers = [*rates[h], x.shape[2], *(x[h] + f[h]).sum(1), *f[h].max(1), *f[h].min(1)]
        for side, weight in enumerate((scored[h] + ridge, conceded[h] + ridge)):
            v = np.concatenate([f[None, h, side], steps[:, side]])
            numbers += [*((v * weight) @ v.T).ravel(), *(v @ weight), weight.sum()]
        stats.append(numbers)
    return f, stats


class _Sweeps:
    """The tasks' side of a sweep: column functions over a row a fit and place. `told`: what the driver says of every fit."""

    def __init__(self, told: dict, halves: int, ridge: float):
        self.told, self.halves, self.ridge = told, halves, ridge

    def _stood(self, scope, cutoff, xs, fs):
        told = self.told[scope, cutoff]
        xs, fs = (np.stack([_floats(v, self.halves, 2, -1) for v in values]) for values in (xs, fs))
        return told, xs, fs, _advanced(told, xs, fs), self._which(told)

    def _which(self, told: dict) -> np.ndarray:
        return np.arange(self.halves) if told["final"] else np.flatnonzero(told["live"])

    def ask(self, asked):
        """A place's ratings, as a message to itself, and those of its teams that other places host."""

        def told(scope: pd.Series, cutoff: pd.Series, xs: pd.Series, fs: pd.Series, place: pd.Series, asked: pd.Series) -> pd.Series:
            out = []
            for row in zip(scope, cutoff, xs, fs, place, asked):
                *_, x, which = self._stood(*row[:4])
                out.append([{"place": row[4], "source": -1, "payload": x[which].tobytes()}] + [
                    {"place": a["place"], "source": row[4], "payload": x[which][:, :, _at(a["at"])].tobytes()} for a in row[5]
                ] if len(which) else [])
            return pd.Series(out)

        return F.pandas_udf(told, MESSAGES)(*FIT, "xs", "fs", "place", asked)

    def meet(self):
        """What a place's pairings add up to for its hosts, as a message to itself, and for each visitor's place."""

        def met(scope: pd.Series, cutoff: pd.Series, place: pd.Series, own: pd.Series, guest: pd.Series, mass: pd.Series, met: pd.Series,
                ends: pd.Series, heard: pd.Series) -> pd.Series:
            return pd.Series([self._meet(*row) for row in zip(scope, cutoff, place, own, guest, mass, met, ends, heard)])

        return F.pandas_udf(met, MESSAGES)(*FIT, "place", "own", "guest", "mass", "met", "ends", "heard")

    def _meet(self, scope, cutoff, place, own, guest, mass, met, ends, heard) -> list[dict]:
        told = self.told[scope, cutoff]
        which = self._which(told)
        if not len(which):
            return []
        by_place = {m["source"]: m["payload"] for m in heard}
        x = _floats(by_place[-1], len(which), 2, -1)
        own, guest, teams = _at(own), _at(guest), x.shape[2]
        if told["final"]:
            mass = np.broadcast_to(_floats(met, 1, -1), (self.halves, len(own)))
        else:
            mass = _floats(mass, self.halves, -1) if len(own) else np.zeros((self.halves, 0))
        visitors = [_floats(by_place[e["place"]], len(which), 2, e["n"]) for e in ends]
        guests = np.concatenate(visitors, axis=2) if visitors else np.zeros((len(which), 2, 0))
        size = guests.shape[2]
        local, away, rates = np.zeros((len(which), 2, teams)), np.zeros((len(which), 2, size)), np.zeros((len(which), 2))
        for i, h in enumerate(which):
            edge, w = np.exp(told["ha"][h]), mass[h]
            attack, leak = np.exp(x[i, 0]), np.exp(-x[i, 1])
            scoring, conceding = np.bincount(own, w * np.exp(-guests[i, 1])[guest], teams), np.bincount(own, w * np.exp(guests[i, 0])[guest], teams)
            rates[i] = attack @ scoring, leak @ conceding
            local[i] = edge * scoring, conceding
            if not told["final"]:
                away[i] = np.bincount(guest, w * leak[own], size), edge * np.bincount(guest, w * attack[own], size)
        if told["final"]:
            return [{"place": place, "source": -1, "payload": rates.tobytes()}]
        cuts = np.cumsum([0, *[e["n"] for e in ends]])
        return [{"place": place, "source": -1, "payload": rates.tobytes() + local.tobytes()}] + [
            {"place": e["place"], "source": place, "payload": away[:, :, a:b].tobytes()} for e, a, b in zip(ends, cuts, cuts[1:])
        ]

    def move(self):
        """The next point, its movement and the numbers for the driver."""

        def moved(scope: pd.Series, cutoff: pd.Series, xs: pd.Series, fs: pd.Series, sums: pd.Series, asked: pd.Series, heard: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([self._move(*row) for row in zip(scope, cutoff, xs, fs, sums, asked, heard)], columns=["x", "f", "stats"])

        return F.pandas_udf(moved, "x binary, f binary, stats array<array<double>>")(*FIT, "xs", "fs", "sums", "asked", "heard")

    def _move(self, scope, cutoff, xs, fs, sums, asked, heard):
        told, xs, fs, x, which = self._stood(scope, cutoff, xs, fs)
        if not len(which):
            return x.tobytes(), fs[-1].tobytes(), [[] for _ in range(self.halves)]
        teams, at = x.shape[2], {a["place"]: _at(a["at"]) for a in asked}
        met, rates = np.zeros((self.halves, 2, teams)), np.zeros((self.halves, 2))
        for m in sorted(heard, key=lambda m: m["source"]):
            if m["source"] < 0:
                numbers = _floats(m["payload"], -1)
                rates[which] = numbers[:2 * len(which)].reshape(-1, 2)
                met[which] += numbers[2 * len(which):].reshape(-1, 2, teams)
            else:
                places = at[m["source"]]
                for h, told_sums in zip(which, _floats(m["payload"], len(which), 2, len(places))):
                    met[h][:, places] += told_sums
        f, stats = _moved(told, xs, fs, x, met, rates, _floats(sums, 3 + 2 * self.halves, teams), self.ridge)
        return x.tobytes(), f.tobytes(), stats

    def rate(self, min_matches: int):
        """Per half-life the ratings of a place's teams, thin ones 0, and what they add to the log likelihood."""

        def rated(scope: pd.Series, cutoff: pd.Series, xs: pd.Series, fs: pd.Series, sums: pd.Series) -> pd.Series:
            out = []
            for row in zip(scope, cutoff, xs, fs, sums):
                *_, x, _ = self._stood(*row[:4])
                total = _floats(row[4], 3 + 2 * self.halves, x.shape[2])
                thin = total[0] < min_matches
                out.append([{
                    "half": h, "attack": np.where(thin, 0.0, x[h, 0]), "defence": np.where(thin, 0.0, x[h, 1]),
                    "matches": np.rint(total[0]).astype(np.int32), "told": float(total[1] @ x[h, 0] - total[2] @ x[h, 1]),
                } for h in range(self.halves)])
            return pd.Series(out)

        schema = "array<struct<half:int,attack:array<double>,defence:array<double>,matches:array<int>,told:double>>"
        return F.pandas_udf(rated, schema)(*FIT, "xs", "fs", "sums")


def fit_spread(cells: DataFrame, halves: Sequence[float | None], config: Config, cutoffs: DataFrame, min_training: int, places: int) -> DataFrame:
    """The fits of `fit_many`, a row a (half-life, scope, cutoff, place) with the ratings of that place's teams.

    `cells`: `pair_cells` of the matches. Fits are solved together, and what is written and shuffled grows with fits times
    pairings, so cutoffs should be few; rho is left to `estimate_rho_distributed`.
    """
    spark = cells.sparkSession
    ensure_checkpoint_dir(spark)
    with _planned_once(spark):
        return _fit_spread(spark, cells, halves, config, cutoffs, min_training, places)


# Adaptive plans forget how written rows are dealt, so every sweep would shuffle its pairings and ratings again.
PLANNING = {"spark.sql.adaptive.enabled": "false"}


@contextmanager
def _planned_once(spark: SparkSession):
    """The sweeps' planner settings, put back afterwards."""
    was = {k: spark.conf.get(k) for k in PLANNING}
    try:
        for k, v in PLANNING.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def _fit_spread(spark, cells, halves, config, cutoffs, min_training, places) -> DataFrame:
    count = len(halves)
    cutoffs = cutoffs.select(*FIT).distinct().checkpoint()
    parts = places * max(1, cutoffs.count())
    placed = _placed(_deal(cells, halves, cutoffs, places, parts), count, parts).checkpoint()
    totals: dict = {}
    for row in placed.select(*FIT, "totals").collect():
        key = (row.scope, row.cutoff)
        totals[key] = totals.get(key, 0.0) + np.array(row.totals)
    points = {k: _Point(v, count) for k, v in totals.items() if v[0] >= max(min_training, 1)}
    known = F.broadcast(spark.createDataFrame(list(points), cells.select("scope").schema.add("cutoff", "long")))
    frame = placed.join(known, FIT, "left_semi").select(*PLACE, "teams", "sums", "asked").checkpoint()
    edges = placed.join(known, FIT, "left_semi").select(*PLACE, "own", "guest", "mass", "met", "ends").checkpoint()
    zeros = F.pandas_udf(lambda teams: teams.map(lambda n: bytes(16 * count * n)), "binary")
    run = f"spread_{uuid.uuid4().hex}"

    def written(rows: DataFrame, sweep: int) -> DataFrame:
        """Ratings in buckets by place. A checkpoint would carry size estimates on, which multiply from sweep to sweep."""
        table = f"{run}_{sweep}"
        to = rows.repartition(parts, *PLACE).write.option("path", f"{spark.sparkContext.getCheckpointDir()}/{table}")
        to.bucketBy(parts, *PLACE).saveAsTable(table)
        tables.append(table)
        return spark.table(table)

    tables: list[str] = []
    states = [written(frame.select(*PLACE, zeros(F.size("teams")).alias("x")).withColumn("f", F.col("x")), 0)]

    def stood() -> DataFrame:
        """The last points, oldest first, joined where they lie."""
        out = states[-1].withColumnsRenamed({"x": "x0", "f": "f0"})
        for i, older in enumerate(states[-2::-1], 1):
            out = out.join(older.withColumnsRenamed({"x": f"x{i}", "f": f"f{i}"}).hint("merge"), PLACE)
        back = range(len(states) - 1, -1, -1)
        return out.select(*PLACE, F.array(*[f"x{i}" for i in back]).alias("xs"), F.array(*[f"f{i}" for i in back]).alias("fs"))

    def sent(rows: DataFrame) -> DataFrame:
        told = rows.select(*FIT, F.explode("out").alias("m")).select(*FIT, "m.*").repartition(parts, *PLACE)
        return told.groupBy(*PLACE).agg(F.collect_list(F.struct("source", "payload")).alias("heard")).hint("merge")

    def meetings(sweep: _Sweeps) -> DataFrame:
        asked = sent(stood().join(frame.hint("merge"), PLACE).withColumn("out", sweep.ask("asked")))
        return edges.join(asked, PLACE, "left").withColumn("out", sweep.meet())

    while any(p.live.any() for p in points.values()):
        sweep = _Sweeps({k: p.told() for k, p in points.items()}, count, config.ridge)
        rows = stood().join(frame.hint("merge"), PLACE).join(sent(meetings(sweep)), PLACE, "left").withColumn("out", sweep.move())
        after = written(rows.select(*PLACE, "out.*"), len(tables))
        states = [*states, after.drop("stats")][-MIXED - 1:]
        heard: dict = {}
        for row in after.select(*FIT, "stats").collect():
            heard.setdefault((row.scope, row.cutoff), []).append(row.stats)
        for k, stats in heard.items():
            points[k].learn([np.array([s[h] for s in stats]) for h in range(count)], config)

    for p in points.values():
        p.final = True
    states = states[-1:]
    sweep = _Sweeps({k: p.told() for k, p in points.items()}, count, config.ridge)
    rates: dict = {}
    for row in meetings(sweep).select(*FIT, F.explode("out.payload").alias("payload")).collect():
        key = (row.scope, row.cutoff)
        rates[key] = rates.get(key, 0.0) + _floats(row.payload, count, 2)
    rated = stood().join(frame.hint("merge"), PLACE).withColumn("out", sweep.rate(config.min_matches))
    rated = rated.select(*PLACE, "teams", F.explode("out").alias("r")).select(*FIT, "teams", "r.*").checkpoint()
    for table in tables:
        spark.sql(f"DROP TABLE {table}")
    linear: dict = {}
    for row in rated.select(*FIT, "half", "told").collect():
        linear[row.scope, row.cutoff, row.half] = linear.get((row.scope, row.cutoff, row.half), 0.0) + row.told
    fits = [
        (h, *k, bool(p.usable[h]), float(p.out_mu[h]), float(p.out_ha[h]), int(p.sweeps[h]), bool(p.converged[h]),
         float(p.flat_goals * p.out_mu[h] + p.flat_home * p.out_ha[h] + linear[*k, h] - p.lg
               - np.exp(p.out_mu[h]) * (np.exp(p.out_ha[h]) * rates[k][h, 0] + rates[k][h, 1])),
         int(round(p.matches)), None)
        for k, p in points.items() for h in range(count)
    ]
    scope = cells.schema["scope"].dataType.simpleString()
    fits = spark.createDataFrame(fits, f"half int, scope {scope}, cutoff bigint, usable boolean, mu double, home_advantage double, sweeps int, "
                                       "converged boolean, log_likelihood double, training_matches bigint, rho double")
    ratings = rated.select("half", *FIT, "teams", "attack", "defence", "matches")
    return ratings.join(F.broadcast(fits), ["half", *FIT]).select(*fits.columns, "teams", "attack", "defence", "matches")
