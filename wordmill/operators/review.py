"""Reviews: the memory model as a fold over each card's answers, due and known words, queues and cards."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

S_KNOWN, NEW_PER_DAY, RETENTION = 30.0, 20, 0.9


@dataclass(frozen=True)
class Memory:
    """Weights of the public FSRS-6 model (fixed values; from memory of its description, not verified here)."""

    w: tuple[float, ...] = (0.212, 1.2931, 2.3065, 8.2956, 6.4133, 0.8334, 3.0194, 0.001, 1.8722, 0.1666, 0.796, 1.4835, 0.0614, 0.2629, 1.6483, 0.6014, 1.8729, 0.5425, 0.0912, 0.0658, 0.1542)
    retention: float = RETENTION

    @property
    def decay(self) -> float:
        return -self.w[20]

    @property
    def factor(self) -> float:
        return 0.9 ** (1 / self.decay) - 1

    def start(self, grade: Column) -> tuple[Column, Column]:
        """Stability and difficulty after the first answer (grade 1..4)."""
        w = self.w
        s = F.element_at(F.array(*(F.lit(x) for x in w[:4])), grade)
        return s, self._bounded(w[4] - F.exp(w[5] * (grade - 1)) + 1)

    @staticmethod
    def _bounded(d: Column) -> Column:
        return F.least(F.greatest(d, F.lit(1.0)), F.lit(10.0))

    def recall(self, days: Column, s: Column) -> Column:
        return F.pow(1 + self.factor * days / s, F.lit(self.decay))

    def interval(self, s: Column) -> Column:
        """Days until recall falls to the retention."""
        return s / self.factor * (self.retention ** (1 / self.decay) - 1)

    def step(self, s: Column, d: Column, days: Column, grade: Column) -> tuple[Column, Column]:
        """Stability and difficulty after a later answer."""
        import math

        w = self.w
        r = self.recall(days, s)
        moved = d - w[6] * (grade - 3) * (10 - d) / 9
        easiest = min(max(w[4] - math.exp(w[5] * 3) + 1, 1.0), 10.0)
        new_d = self._bounded(w[7] * easiest + (1 - w[7]) * moved)
        good = s * (1 + math.exp(w[8]) * (11 - d) * F.pow(s, F.lit(-w[9])) * (F.exp(w[10] * (1 - r)) - 1) * F.when(grade == 2, w[15]).otherwise(1.0) * F.when(grade == 4, w[16]).otherwise(1.0))
        lapse = F.least(s, w[11] * F.pow(d, F.lit(-w[12])) * (F.pow(s + 1, F.lit(w[13])) - 1) * F.exp(w[14] * (1 - r)))
        same_day = s * F.exp(w[17] * (grade - 3 + w[18])) * F.pow(s, F.lit(-w[19]))
        new_s = F.when(days < 1, same_day).when(grade == 1, lapse).otherwise(good)
        return F.greatest(new_s, F.lit(0.001)), new_d


def card_states(log: DataFrame, memory: Memory = Memory()) -> DataFrame:
    """card_id, user_id, stability, difficulty, reps, lapses, state, last_answer_at, next_due: a fold inside the engine.

    log: card_id, user_id, event_id, ts, quality 0..3. An answer's day distance is in calendar days; a failed card is due
    again after ten minutes, others after the rounded interval (one day at least). One card's answers are one array: it
    grows with a single person's history of a single card only.
    """
    answer = F.struct("ts", "event_id", (F.col("quality") + 1).alias("g"))
    rows = log.groupBy("card_id", "user_id").agg(F.array_sort(F.collect_list(answer)).alias("__log"))
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("d"), F.lit(0).alias("reps"), F.lit(0).alias("lapses"), F.lit(None).cast(log.schema["ts"].dataType).alias("at"), F.lit(0).alias("g"))

    def merge(acc: Column, x: Column) -> Column:
        first = acc["reps"] == 0
        days = F.datediff(x["ts"], acc["at"]).cast("double")
        s0, d0 = memory.start(x["g"])
        s1, d1 = memory.step(acc["s"], acc["d"], days, x["g"])
        return F.struct(
            F.when(first, s0).otherwise(s1).alias("s"),
            F.when(first, d0).otherwise(d1).alias("d"),
            (acc["reps"] + 1).alias("reps"),
            (acc["lapses"] + F.when(~first & (x["g"] == 1), 1).otherwise(0)).alias("lapses"),
            x["ts"].alias("at"),
            x["g"].alias("g"),
        )

    done = rows.select("card_id", "user_id", F.aggregate("__log", zero, merge).alias("f"))
    days = F.greatest(F.lit(1), F.round(memory.interval(F.col("f.s"))).cast("int"))
    due = F.when(F.col("f.g") == 1, F.col("f.at") + F.expr("interval 10 minutes")).otherwise(F.col("f.at") + F.make_dt_interval(days))
    state = F.when((F.col("f.g") == 1) & (F.col("f.reps") > 1), "relearning").when(F.col("f.g") == 1, "learning").otherwise("review")
    return done.select("card_id", "user_id", F.col("f.s").alias("stability"), F.col("f.d").alias("difficulty"), F.col("f.reps").alias("reps"), F.col("f.lapses").alias("lapses"), state.alias("state"), F.col("f.at").alias("last_answer_at"), due.alias("next_due"))


def without(df: DataFrame, ignored: DataFrame, keys: tuple[str, ...] = ("user_id", "k")) -> DataFrame:
    """df without ignored words; keys compare null-safely."""
    other = ignored.select(*(F.col(k).alias(f"__{k}") for k in keys)).distinct()
    on = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"__{k}"))
        on = c if on is None else on & c
    return df.join(other, on, "left_anti")


def known_words(states: DataFrame, marks: DataFrame, ignored: DataFrame, s_known: float = S_KNOWN) -> DataFrame:
    """user_id, k: marked as known or of stability s_known, and not ignored."""
    mature = states.where(F.col("stability") >= s_known).select("user_id", "k")
    return without(mature.union(marks.select("user_id", "k")).distinct(), ignored)


def due_cards(states: DataFrame, ignored: DataFrame, now: Column) -> DataFrame:
    return without(states.where(F.col("next_due") <= now), ignored)


def new_capacity(users: DataFrame, log: DataFrame, day: Column, per_day: int = NEW_PER_DAY) -> DataFrame:
    """user_id, learned_today, capacity: cards whose first answer is on the day count against the cap."""
    first = log.groupBy("user_id", "card_id").agg(F.min("ts").alias("first"))
    today = first.where(F.to_date("first") == day).groupBy("user_id").agg(F.count("*").alias("learned_today"))
    joined = users.join(today, "user_id", "left").fillna(0, ["learned_today"])
    return joined.select("user_id", "learned_today", F.greatest(F.lit(0), per_day - F.col("learned_today")).cast("bigint").alias("capacity"))


def new_items(words: DataFrame, states: DataFrame, ignored: DataFrame, marks: DataFrame) -> DataFrame:
    """words (user_id, k, ...) without a card state, not ignored and not marked as known."""
    return without(without(without(words, states), ignored), marks)


def queue(due: DataFrame, new: DataFrame, capacity: DataFrame) -> DataFrame:
    """user_id, k, kind, place: due cards by date, then new ones up to the user's capacity."""
    reviews = due.select("user_id", "k", F.lit("review").alias("kind"), F.lit(0).alias("__o"), F.col("next_due").alias("__t"))
    w = Window.partitionBy("user_id").orderBy("k")
    fresh = new.withColumn("__r", F.row_number().over(w)).join(capacity, "user_id").where(F.col("__r") <= F.col("capacity"))
    fresh = fresh.select("user_id", "k", F.lit("new").alias("kind"), F.lit(1).alias("__o"), F.lit(None).cast("timestamp_ntz").alias("__t"))
    order = Window.partitionBy("user_id").orderBy("__o", "__t", "k")
    return reviews.union(fresh).withColumn("place", F.row_number().over(order)).select("user_id", "k", "kind", "place")


def next_cards(queue_: DataFrame) -> DataFrame:
    """Each user's first card: a due one if there is any, else a new one; users with an empty queue have no row."""
    return queue_.groupBy("user_id").agg(F.min_by(F.struct("k", "kind"), "place").alias("__c")).select("user_id", "__c.k", "__c.kind")


def dashboard(states: DataFrame, log: DataFrame, marks: DataFrame, ignored: DataFrame, now: Column) -> DataFrame:
    """user_id, known_count, due_count, new_capacity_today."""
    users = log.select("user_id").union(marks.select("user_id")).distinct()
    known = known_words(states, marks, ignored).groupBy("user_id").agg(F.count("*").alias("known_count"))
    due = due_cards(states, ignored, now).groupBy("user_id").agg(F.count("*").alias("due_count"))
    capacity = new_capacity(users, log, F.to_date(now)).select("user_id", F.col("capacity").alias("new_capacity_today"))
    return users.join(known, "user_id", "left").join(due, "user_id", "left").join(capacity, "user_id").fillna(0, ["known_count", "due_count"])


def mark(marks: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("user_id", "k")) -> DataFrame:
    """The marks with new ones; each once."""
    return marks.select(*keys).union(new.select(*keys)).distinct()


def seed_known(states: DataFrame, marks: DataFrame, s_known: float = S_KNOWN) -> DataFrame:
    """States in which cards marked as known are mature."""
    marked = marks.select(F.col("user_id").alias("__u"), F.col("k").alias("__k")).distinct()
    joined = states.join(marked, (F.col("user_id") == F.col("__u")) & (F.col("k") == F.col("__k")), "left")
    return joined.withColumn("stability", F.when(F.col("__u").isNotNull(), F.greatest("stability", F.lit(s_known))).otherwise(F.col("stability"))).drop("__u", "__k")
