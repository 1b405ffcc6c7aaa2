"""Who ran a query."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How service accounts are told apart.
SERVICE_ACCOUNT_SUFFIX = ".gserviceaccount.com"
SERVICE_ACCOUNT_PREFIX = "service-"
UNKNOWN = "Unknown"


def service_account(email: Column) -> Column:
    """The email itself for a service account, else NULL."""
    return F.when(
        email.endswith(SERVICE_ACCOUNT_SUFFIX) | email.startswith(SERVICE_ACCOUNT_PREFIX), email
    )


def spender(account: Column, email: Column) -> Column:
    """Service account, else email, else 'Unknown'; empty text counts as missing."""
    return F.coalesce(F.nullif(account, F.lit("")), F.nullif(email, F.lit("")), F.lit(UNKNOWN))


def is_account(account: Column) -> Column:
    return F.coalesce(account != "", F.lit(False))


def short_name(name: Column) -> Column:
    """The part before the @ sign."""
    return F.substring_index(name, "@", 1)


def short_spender(name: Column, account: Column) -> Column:
    """Short name; a service account's first 'service-' becomes 'SA:'."""
    short = short_name(name)
    return F.when(account, F.regexp_replace(short, "^(.*?)service-", "$1SA:")).otherwise(short)
