"""Column expressions over log lines (P1-P4, S12 feature conformance)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from huntlake import schemas as S
from huntlake.functions.cols import as_col


def classify_rule(event: str | Column = "event") -> Column:
    """P1: 'attaque' when the event contains the attack marker (case-sensitive)."""
    e = as_col(event)
    return (F.when(e.contains(S.ATTACK_MARKER), F.lit(S.LABEL_ATTACK))
            .otherwise(F.lit(S.LABEL_NORMAL)))


def anomaly_to_label(is_anomaly: str | Column = "is_anomaly") -> Column:
    """Boolean anomaly flag to the attack / normal label."""
    return (F.when(F.coalesce(as_col(is_anomaly), F.lit(False)), F.lit(S.LABEL_ATTACK))
            .otherwise(F.lit(S.LABEL_NORMAL)))


def text_features(event: str | Column = "event") -> list[Column]:
    """Length, non-overlapping count of the attack marker, count of '_'."""
    e = as_col(event)
    return [
        F.char_length(e).alias("event_length"),
        F.regexp_count(e, F.lit(S.ATTACK_MARKER)).cast("int").alias("marker_count"),
        (F.char_length(e) - F.char_length(F.replace(e, F.lit("_"), F.lit("")))).cast("int")
        .alias("underscore_count"),
    ]


def _tokens(event: str | Column) -> Column:
    return F.split(F.lower(as_col(event)), "_")


def keyword_features(event: str | Column = "event") -> list[Column]:
    """The 17 flow features derived from the keywords of an event name.

    Tokens are the lower-cased event split on '_'; every rule is a token test,
    so the whole feature vector is one native projection.
    """
    tok = _tokens(event)

    def has(word: str) -> Column:
        return F.array_contains(tok, word)

    def count(word: str) -> Column:
        return F.size(F.filter(tok, lambda x: x == F.lit(word)))

    def pick(cond: Column, values: tuple) -> Column:
        return F.when(cond, F.lit(values[0])).otherwise(F.lit(values[1]))

    def bit(cond: Column) -> Column:
        return F.when(cond, F.lit(1)).otherwise(F.lit(0))

    exfil = has("exfiltration")
    scan = has("scan")
    ack = has("ack")
    feats = {
        "Flow Duration": pick(exfil, S.KEYWORD_DURATION).cast("double"),
        "Total Fwd Packet": count("fwd").cast("double"),
        "Total Bwd packets": count("bwd").cast("double"),
        "Flow Bytes/s": pick(exfil | has("c2"), S.KEYWORD_BYTES_RATE),
        "Flow Packets/s": pick(scan, S.KEYWORD_PACKET_RATE),
        "Packet Length Mean": pick(ack, S.KEYWORD_LENGTH_MEAN),
        "FIN Flag Count": bit(has("fin")).cast("double"),
        "SYN Flag Count": bit(has("syn") | scan).cast("double"),
        "RST Flag Count": bit(has("rst")).cast("double"),
        "PSH Flag Count": bit(has("psh")).cast("double"),
        "ACK Flag Count": bit(ack).cast("double"),
    }
    for name, value in S.KEYWORD_CONSTANTS.items():
        feats[name] = F.lit(float(value))
    return [feats[name].alias(name) for name in S.EXPECTED_FEATURES]
