"""Quality rules whose votes are weighed instead of all having to pass.

Every rule votes on a document's counts or abstains; a label model learnt from all documents' votes
says how far each rule can be trusted, and a document stays if it is probably good.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .profiles import profiled
from .weak import LabelModel, learn, pattern, posterior_of, vote

LEAST_WORDS = 50
KEEP_FROM = 0.5
# Shares of a shorter text say nothing: all rules abstain.
LEAST_VOTED = 20


def base_failed(p: Column) -> Column:
    """Too short, or more than half of its words in repeated windows."""
    return (p["n_words"] < LEAST_WORDS) | (100 * p["n_repeat_words"] > 50 * p["n_words"])


def rules(p: Column) -> list[Column]:
    """Votes on a profile: shares are of words, code points in words, letters or lines.

    Every kind of junk is in sight of two rules at least, so a single odd trait does not reject.
    """
    share = lambda part, whole: F.when(p["n_words"] >= LEAST_VOTED, p[part] / F.when(p[whole] > 0, p[whole]))
    symbols, repeats = share("n_symbols", "n_words"), share("n_repeat_words", "n_words")
    lines, length = F.when(p["n_lines"] >= 4, share("n_dup_lines", "n_lines")), share("word_chars", "n_words")
    letters, upper = share("n_letters", "word_chars"), share("n_upper", "n_letters")
    echoes, letterless = share("n_echoes", "n_words"), share("n_letterless", "n_words")
    marks = share("n_marks", "word_chars")
    return [
        vote(symbols, symbols < 0.02, symbols > 0.2),
        vote(repeats, repeats < 0.15, repeats > 0.4),
        vote(lines, lines < 0.1, lines > 0.3),
        vote(length, length.between(3.5, 9), (length < 2.5) | (length > 14)),
        vote(letters, letters > 0.9, letters < 0.75),
        vote(upper, upper < 0.12, upper > 0.4),
        vote(echoes, echoes < 0.05, echoes > 0.2),
        vote(letterless, letterless < 0.08, letterless > 0.25),
        vote(marks, marks < 0.08, marks > 0.15),
    ]


def judged(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document the key, its counts, ``base_failed``, ``posterior`` and ``kept``.

    Null and empty texts have no words: they fail the base rules and get no votes, so their posterior
    is the prior.  Repeated rows are judged alike, each with its own vote in the model; a null key
    stays null; an empty table gives no rows.
    """
    p = F.col("_profile")
    counted = docs.select(F.col(key), profiled(text).alias("_profile"))
    votes = rules(p)
    counted = written(counted.select(key, "_profile", base_failed(p).alias("base_failed"), pattern(votes).alias("pattern")), "rules")
    _, posteriors = learn(counted, len(votes))
    posterior = posterior_of(F.col("pattern"), posteriors)
    return counted.select(
        key, *[p[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], "base_failed",
        posterior.alias("posterior"), (~F.col("base_failed") & (posterior >= KEEP_FROM)).alias("kept"),
    )


def kept(docs: DataFrame, text: str = "text") -> tuple[DataFrame, LabelModel]:
    """The documents that pass, all columns, and the label model.

    Texts are counted twice, once for the model and once to filter, so that they are never shuffled.
    """
    p = F.col("_profile")
    votes = rules(p)
    model, posteriors = learn(docs.select(profiled(text).alias("_profile")).select(pattern(votes).alias("pattern")), len(votes))
    judged_rows = docs.select(F.struct("*").alias("_doc"), profiled(text).alias("_profile"))
    good = posterior_of(pattern(votes), posteriors) >= KEEP_FROM
    return judged_rows.where(~base_failed(p) & good).select("_doc.*"), model
