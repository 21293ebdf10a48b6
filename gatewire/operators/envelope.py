"""Opening the envelopes of authorization messages: raw bytes in, JSON text out."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gatewire.functions import envelope as env
from gatewire.functions.brotli import inflate
from gatewire.functions.problems import NO_PROBLEMS, add_problems, problem
from gatewire.vocabulary import BROTLI_MESSAGE_VERSION, SHORTEST_MESSAGE_BYTES


def drop_short(messages: DataFrame, body: str = "body") -> DataFrame:
    """Messages too short to hold anything vanish without a trace; they aren't errors."""
    return messages.where(F.length(body) >= SHORTEST_MESSAGE_BYTES)


def classify(messages: DataFrame, body: str = "body") -> DataFrame:
    return messages.withColumn("message_class", env.message_class(F.col(body)))


def unwrap(messages: DataFrame, body: str = "body") -> DataFrame:
    """Add ``version`` and ``content``: the payload behind the version, or the bare document without one.

    ``content`` is NULL for input that is not base64 although it would have to be.
    """
    raw = F.col(body)
    is_base64 = F.col("message_class") == env.BASE64
    return (
        classify(messages, body)
        .withColumn("_open", F.when(is_base64, env.strict_base64(raw)).otherwise(raw))
        .withColumn("version", F.when(F.col("message_class") != env.PLAIN, env.leading_version(F.col("_open"))))
        .withColumn(
            "content",
            F.when(F.col("version").isNotNull(), F.substring("_open", 3, 2147483647)).otherwise(F.col("_open")),
        )
        .drop("_open")
    )


def decode(messages: DataFrame, body: str = "body") -> DataFrame:
    """Add ``json`` (NULL when the envelope is broken) and ``problems`` to every message worth reading.

    One pass over the input: rows go through Python, which inflates the compressed payloads, whereas
    splitting by class would read and classify the source twice.  What comes along is the
    message and what its base64 held, each once; a bare document is the message itself.
    """
    version = F.col("version")
    content = F.col("content")
    is_compressed = version == BROTLI_MESSAGE_VERSION
    is_bare = F.col("message_class") == env.PLAIN
    found = F.concat_ws(
        ",",
        problem("bad_base64", {body: content.isNull()}),
        problem(
            "too_short_decoded",
            {
                body: (F.col("message_class") == env.BASE64)
                & version.isNull()
                & (F.length(content) < SHORTEST_MESSAGE_BYTES)
            },
        ),
        problem("unsupported_version", {body: version != BROTLI_MESSAGE_VERSION}),
    )
    unwrapped = unwrap(drop_short(messages, body), body).select(
        *messages.columns,
        found.alias("problems"),
        F.coalesce(is_compressed, F.lit(False)).alias("_packed"),
        is_bare.alias("_bare"),
        F.when(is_compressed | (version.isNull() & ~is_bare), content).alias("_content"),
    )
    opened = inflate(unwrapped, "_content", "_packed")
    not_inflated = F.col("_packed") & F.col("_content").isNull()
    document = F.when(F.col("_bare"), F.col(body)).otherwise(F.col("_content"))
    return (
        opened.withColumn("problems", add_problems(F.col("problems"), problem("bad_brotli", {body: not_inflated})))
        .withColumn("json", F.when(F.col("problems") == NO_PROBLEMS, env.document_text(document)))
        .drop("_packed", "_bare", "_content")
    )
