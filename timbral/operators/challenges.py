"""Challenges drawn for sessions, scripts to be read, and what a response is worth.

Draws come from SHA-256 of the session and a secret seed: a rerun gives the same challenge, and who
does not know the seed cannot foresee one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timbral.functions import text as T

TYPES = ("digit_sequence", "phonetic_phrase", "prompt_repeat", "arithmetic")
#: Texts, fewest and most digits, and whether digits may repeat.
DIGIT_TEMPLATES = (
    ("Say the digits: {digits}", 4, 10, True),
    ("Please read this number: {digits}", 4, 10, True),
    ("Speak the following numbers in order: {digits}", 5, 8, False),
)
#: Phrases to be said.
PHRASES = (
    "The quick brown fox jumps over the lazy dog",
    "She sells seashells by the seashore",
    "How much wood would a woodchuck chuck",
    "Peter Piper picked a peck of pickled peppers",
    "Unique New York unique New York",
    "Red leather yellow leather",
    "The early bird catches the worm",
    "A stitch in time saves nine",
    "All that glitters is not gold",
    "The pen is mightier than the sword",
)
#: Prompts to be repeated.
PROMPTS = (
    "My voice is my passport",
    "Verify me by my voice today",
    "Access granted through voice recognition",
    "Authentication is active now",
    "Confirm my identity with these words",
    "Voice biometrics in progress",
    "Secure access with my voice print",
    "Validation of my unique voice",
    "This is a voice verification test",
    "Proving my identity vocally",
)
#: Scripts to be read, by family; those of the last one by emotion.
SCRIPTS = {
    "phonetic_balanced": (
        "The quick brown fox jumps over the lazy dog.",
        "She sells seashells by the seashore.",
        "How much wood would a woodchuck chuck if a woodchuck could chuck wood?",
        "Peter Piper picked a peck of pickled peppers.",
        "Unique New York, unique New York, you know you need unique New York.",
    ),
    "digits": (
        "Zero one two three four five six seven eight nine.",
        "Nine eight seven six five four three two one zero.",
        "Three one four one five nine two six five three five.",
        "Seven zero two four six eight zero zero one nine.",
        "Five five five one two three four five six seven.",
    ),
    "command_phrases": ("Open the file.", "Call home.", "Set an alarm for seven A.M.", "What's the weather today?", "Play some music."),
}
EMOTIONS = {
    "happy": "I'm so excited about this wonderful news!",
    "sad": "Unfortunately, I have to cancel our plans.",
    "angry": "This is absolutely unacceptable!",
    "neutral": "The train arrives at six thirty in the evening.",
    "surprised": "Wow! I didn't expect to see you here!",
}


def draw(session: Column, name: Column | str, n: Column | int, seed: str = "") -> Column:
    """A number from 0 to n - 1 for a session and the name of what is drawn."""
    name = F.lit(name) if isinstance(name, str) else name
    digest = F.sha2(F.concat_ws(":", F.lit(seed), session, name), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 12), 16, 10).cast("long"), F.lit(n) if isinstance(n, int) else n)


def _pick(values: tuple, at: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), at.cast("int"))


def _graded(difficulty: Column, easy: Column, medium: Column, hard: Column) -> Column:
    """A difficulty that is not known counts as hard, as null does."""
    return F.when(difficulty == "easy", easy).when(difficulty == "medium", medium).otherwise(hard)


def digits(session: Column, difficulty: Column, seed: str = "") -> Column:
    """struct(text, display, expected). How many digits follows the template and the
    difficulty; where none may repeat they are a start of a shuffled 0 to 9."""
    at = draw(session, "template", len(DIGIT_TEMPLATES), seed)
    low, high = _pick(tuple(t[1] for t in DIGIT_TEMPLATES), at), _pick(tuple(t[2] for t in DIGIT_TEMPLATES), at)
    count = _graded(difficulty, low + draw(session, "count", 3, seed), low + 1 + draw(session, "count", high - low - 1, seed), high).cast("int")
    free = F.transform(F.sequence(F.lit(1), count), lambda i: draw(session, F.concat(F.lit("digit"), i.cast("string")), 10, seed).cast("string"))
    order = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.struct(draw(session, F.concat(F.lit("order"), i.cast("string")), 1 << 40, seed).alias("o"), i.cast("string").alias("d"))))
    expected = F.array_join(F.when(_pick(tuple(t[3] for t in DIGIT_TEMPLATES), at), free).otherwise(F.slice(F.transform(order, lambda s: s["d"]), 1, count)), "")
    text = F.replace(_pick(tuple(t[0] for t in DIGIT_TEMPLATES), at), F.lit("{digits}"), T.spoken_digits(expected))
    return F.struct(text.alias("text"), text.alias("display"), expected.alias("expected"))


def phrase(session: Column, seed: str = "") -> Column:
    """A phrase to be said."""
    own = _pick(PHRASES, draw(session, "phrase", len(PHRASES), seed))
    text = F.concat(F.lit("Please say: '"), own, F.lit("'"))
    return F.struct(text.alias("text"), text.alias("display"), own.alias("expected"))


def prompt(session: Column, seed: str = "") -> Column:
    """A prompt to be repeated."""
    own = _pick(PROMPTS, draw(session, "prompt", len(PROMPTS), seed))
    text = F.concat(F.lit("Repeat after me: '"), own, F.lit("'"))
    return F.struct(text.alias("text"), text.alias("display"), own.alias("expected"))


def arithmetic(session: Column, difficulty: Column, seed: str = "") -> Column:
    """Easy adds single digits; medium adds 10 to 50 or multiplies 2 to 9; hard adds 10 to 99,
    subtracts something smaller from 50 to 99, or multiplies 5 to 15."""
    between = lambda name, low, high: low + draw(session, name, high - low + 1, seed)
    kind = _graded(difficulty, F.lit(0).cast("long"), 2 * draw(session, "kind", 2, seed), draw(session, "kind", 3, seed))
    of = lambda add, less, times: F.when(kind == 0, add).when(kind == 1, less).otherwise(times)
    a = of(_graded(difficulty, between("a", 1, 9), between("a", 10, 50), between("a", 10, 99)), between("a", 50, 99), _graded(difficulty, F.lit(0).cast("long"), between("a", 2, 9), between("a", 5, 15)))
    smaller = F.lit(10) + draw(session, "b", a - 10, seed)
    b = of(_graded(difficulty, between("b", 1, 9), between("b", 10, 50), between("b", 10, 99)), smaller, _graded(difficulty, F.lit(0).cast("long"), between("b", 2, 9), between("b", 5, 15)))
    sign = of(F.lit("+"), F.lit("-"), F.lit("×"))
    sum_ = F.concat_ws(" ", a.cast("string"), sign, b.cast("string"))
    return F.struct(F.concat(F.lit("Calculate and say the answer: "), sum_).alias("text"), F.concat(sum_, F.lit(" = ?")).alias("display"), of(a + b, a - b, a * b).cast("string").alias("expected"))


def issue(sessions: DataFrame, session: str, difficulty: str, created: str, seed: str = "", ttl_seconds: int = 120) -> DataFrame:
    """Sessions with challenge_type, challenge_text, challenge_display, expected_response,
    created_at, expires_at and verification_hash, one type drawn for each session. A null session
    has no challenge. Repeated sessions get the same one."""
    own, hard = F.col(session).cast("string"), F.col(difficulty)
    kind = draw(own, "type", len(TYPES), seed)
    made = F.when(kind == 0, digits(own, hard, seed)).when(kind == 1, phrase(own, seed)).when(kind == 2, prompt(own, seed)).otherwise(arithmetic(own, hard, seed))
    rows = sessions.withColumn("__c", F.when(own.isNotNull(), made)).withColumn("challenge_type", F.when(own.isNotNull(), _pick(TYPES, kind)))
    given = {"challenge_text": "__c.text", "challenge_display": "__c.display", "expected_response": "__c.expected"}
    rows = rows.withColumns({k: F.col(v) for k, v in given.items()}).drop("__c")
    expires = F.col(created) + F.expr(f"interval {int(ttl_seconds)} seconds")
    hashed = T.verification_hash(own, F.col("expected_response"), F.unix_timestamp(F.col(created).cast("timestamp")).cast("string"))
    return rows.withColumn("created_at", F.col(created)).withColumn("expires_at", expires).withColumn("verification_hash", hashed)


def for_user(challenges: DataFrame) -> DataFrame:
    """What the user gets: all but the expected response."""
    return challenges.drop("expected_response")


def judge(responses: DataFrame, challenges: DataFrame, session: str, response: str, at: str, difficulty: str) -> DataFrame:
    """(session, response, verified, similarity, threshold, error) of each response. Texts are
    normalized and compared; the difficulty says how alike they must be. Without a challenge of that
    session, or after it expired (its last second still counts), the error says so and similarity is
    null. A null response is like nothing."""
    own = challenges.select(session, F.col("expected_response").alias("__e"), F.col("expires_at").alias("__x"), F.col(difficulty).alias("__d"))
    rows = responses.join(own, session, "left")
    error = F.when(F.col("__e").isNull(), "Invalid session ID").when(F.col(at) > F.col("__x"), "Challenge expired")
    alike = T.sequence_ratio(T.normalize_text(F.col("__e")), T.normalize_text(F.coalesce(response, F.lit(""))))
    threshold = reduce(lambda c, kv: F.when(F.col("__d") == kv[0], F.lit(kv[1])).otherwise(c), T.VERDICT_THRESHOLDS.items(), F.lit(T.VERDICT_THRESHOLDS["hard"]))
    rows = rows.withColumn("error", error).withColumn("similarity", F.when(error.isNull(), alike)).withColumn("threshold", F.when(error.isNull(), threshold))
    return rows.withColumn("verified", F.coalesce(F.col("similarity") >= F.col("threshold"), F.lit(False))).drop("__e", "__x", "__d")


def script(family: Column, index: Column, emotion: Column, session: Column, seed: str = "") -> Column:
    """The script of a family and an index; an emotion's one of the family emotional; where
    the index is null or beyond the family, one drawn for the session. An unknown family counts as
    phonetic_balanced, as does emotional with an unknown emotion."""
    families = F.create_map(*[x for k, v in SCRIPTS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    texts = F.coalesce(F.try_element_at(families, family), F.array(*map(F.lit, SCRIPTS["phonetic_balanced"])))
    chosen = F.coalesce(F.when(index >= 0, F.get(texts, index.cast("int"))), F.get(texts, draw(session, "script", F.size(texts), seed).cast("int")))
    felt = F.try_element_at(F.create_map(*[F.lit(x) for kv in EMOTIONS.items() for x in kv]), emotion)
    return F.when(family == "emotional", F.coalesce(felt, chosen)).otherwise(chosen)
