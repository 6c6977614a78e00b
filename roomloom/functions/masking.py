"""Masking of secrets in log text and log objects.

A text without what a rule needs (a colon, a quote behind one, an at sign) is left as
it is without a search for all the keys.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import BLANKS, S

#: Keys whose values are secret.
SECRET_KEYS = (
    "password", "passwd", "pwd", "pass", "secret", "secret_key", "client_secret",
    "key", "api_key", "apikey", "private_key", "public_key", "supabase_key",
    "token", "access_token", "refresh_token", "id_token", "bearer",
    "authorization", "auth", "x-api-key", "cookie", "session", "session_id", "sessionid",
    "device_id", "x-device-id",
    "user_id", "email", "phone", "mobile", "address", "ssn", "resident_number",
    "credit_card", "card_number", "cvc", "cvv", "account_number",
    "database_url", "db_password", "connection_string",
)
#: Headers whose values are masked to the end of the line.
SECRET_HEADERS = ("authorization", "cookie", "x-auth-token", "set-cookie")
#: What stays of a masked value, address or number.
MASK, MASKED_EMAIL, MASKED_PHONE = "***", "***@***.***", "***-****-****"
#: Patterns of addresses and numbers.
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
PHONE = r"\b\d{2,3}-\d{3,4}-\d{4}\b"

#: The longest of keys that start alike counts.
KEYS = "|".join(sorted(SECRET_KEYS, key=lambda k: (-len(k), k)))
HEADERS = "|".join(sorted(SECRET_HEADERS, key=lambda k: (-len(k), k)))

#: (what a text must have for the rule, pattern, what takes its place), in order.
RULES = (
    (":", rf"(?i)({HEADERS}){S}*:{S}*[^;\n]+", f"$1: {MASK}"),
    (rf"[:=]{S}*[\"']", rf"(?id)(([\"']?)({KEYS})\2{S}*[:=]{S}*)([\"'])(.*?)\4", f"$1$4{MASK}$4"),
    (rf"[A-Za-z][\"']?{S}*[:=]", rf"(?i)(([\"']?)({KEYS})\2{S}*[:=]{S}*)([^\"',{BLANKS};&]+)", f"$1{MASK}"),
    ("@", f"(?U){EMAIL}", MASKED_EMAIL),
    (r"\d-\d{3,4}-\d", f"(?U){PHONE}", MASKED_PHONE),
)


def mask_text(text: Column) -> Column:
    """The five rules one after the other; null stays null."""
    def masked(rest: tuple):
        if not rest:
            return lambda c: c
        hint, pattern, instead = rest[0]
        # Bound to a name, so that each rule is applied once a row.
        step = lambda c: F.when(c.rlike(hint), F.regexp_replace(c, pattern, instead)).otherwise(c)
        return lambda c: F.transform(F.array(step(c)), masked(rest[1:]))[0]

    return masked(RULES)(text)


_ALL = {*SECRET_KEYS, *SECRET_HEADERS}


def _mask(value, depth: int = 0):
    if depth > 10:
        return str(value)
    if isinstance(value, dict):
        return {k: MASK if str(k).lower() in _ALL else _mask(v, depth + 1) for k, v in value.items()}
    if isinstance(value, list):
        return [_mask(v, depth + 1) for v in value]
    return value


@F.pandas_udf(StringType())
def mask_json(body: pd.Series) -> pd.Series:
    """JSON objects with the values of secret keys replaced; other text is left alone.

    The object is read and written anew: numbers may be written otherwise, and of a
    repeated key the last stays.
    """

    def one(text):
        try:
            return None if text is None else json.dumps(_mask(json.loads(text)), ensure_ascii=False)
        except ValueError:
            return text

    return body.map(one)


def mask_body(body: Column) -> Column:
    """A record's body by its type: of an object its secret values, else what a text may hold."""
    is_object = F.ltrim(body).startswith("{") & F.get_json_object(body, "$").isNotNull()
    return F.coalesce(mask_json(F.when(is_object, body)), F.when(~F.coalesce(is_object, F.lit(False)), mask_text(body)))
