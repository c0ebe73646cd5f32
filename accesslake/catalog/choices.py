"""What the overviews count on the fixture tables: the library takes these as arguments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def user_measures() -> dict[str, Column]:
    """No MFA without a positive balance, first login with one from 0 to 100, password due above 9000, no face vectors."""
    balance = F.col("balance")
    return {
        "total": F.count("*"),
        "not_enabled_mfa": F.count_if(balance <= 0),
        "first_login": F.count_if(balance.between(0, 100)),
        "valid": F.count_if(F.col("is_active")),
        "face_vector": F.lit(0).cast("bigint"),
        "need_update_password": F.count_if(balance > 9000),
    }


def asset_measures() -> dict[str, Column]:
    """Active below the price of 1500, connected below 1200, zones are categories, directory services the PROMO ones."""
    return {
        "total": F.count("*"),
        "active": F.count_if(F.col("price") < 1500),
        "connected": F.count_if(F.col("price") < 1200),
        "zone": F.count_distinct("category"),
        "directory_services": F.count_if(F.col("category") == "PROMO"),
        "platform_count": F.count_distinct("platform"),
    }


def account_measures(as_of, days: int) -> dict[str, Column]:
    """Active with more than one login, connected with one in the last year, switched from when privileged, the secret
    changed inside the window, templates are usernames."""
    since = F.datediff(F.lit(str(as_of)[:10]).cast("date"), F.col("date_last_login"))
    return {
        "total": F.count("*"),
        "active": F.count_if(F.col("logins") > 1),
        "connected": F.count_if(since.between(0, 364)),
        "su_from": F.count_if(F.col("privileged")),
        "date_change_secret": F.count_if(since.between(0, days - 1)),
        "template_total": F.count_distinct("username"),
    }


def log_kinds() -> dict[str, Column]:
    """Which event types stand for which log."""
    kind = F.col("event_type")
    return {
        "logins": F.lit(True),
        "operations": kind.isin("click", "view"),
        "password_changes": kind == "signup",
        "file_logs": kind == "purchase",
        "jobs": kind != "view",
    }


def login_success() -> Column:
    return F.col("event_type") != "error"


def privileged() -> Column:
    """Every fifth user."""
    return F.col("username") % 5 == 0
