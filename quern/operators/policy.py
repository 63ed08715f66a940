"""Rights and authorization: every broken rule of a declaration, as an array."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions import text

CLASSES = ("unknown", "private", "paid-personal", "licensed", "owned", "public")
BASES = ("licensed-dataset", "official-api", "operator-approved-export", "account-owned-export", "public")


def text_unsafe(c: Column) -> Column:
    """Whether policy text shows credentials or a URL that carries them."""
    c = F.coalesce(c, F.lit(""))
    kinds = text.secret_kinds(c)
    return (F.size(F.array_intersect(kinds, F.array(F.lit("credential_value"), F.lit("credential_header"), F.lit("secret_assignment")))) > 0) | c.rlike(r"(?i)^https?://[^/?#\s]*@")


def violations(access: str = "access_class", status: str = "rights_status", uses: str = "permitted_uses", notes: str = "notes", basis: str = "basis", approval: str = "approval_id", owner: str = "account_owner", local_only: str = "local_only") -> Column:
    """Names of the broken rules, in fixed order, over columns of a declaration."""
    a, s, b, n = F.col(access), F.col(status), F.col(basis), F.coalesce(F.col(notes), F.lit(""))
    u = F.transform(F.coalesce(F.col(uses), F.array().cast("array<string>")), text.strip)
    ok, own = F.coalesce(F.col(approval), F.lit("")), F.coalesce(F.col(owner), F.lit(""))
    rules = [
        ("access-class", ~F.coalesce(a.isin(*CLASSES), F.lit(False))),
        ("rights-status", ~F.coalesce(s.isin(*CLASSES), F.lit(False))),
        ("status-matches-class", ~a.eqNullSafe(s)),
        ("uses-present", (F.size(u) == 0) | F.exists(u, lambda x: (x == "") | (F.length(x) > 100))),
        ("uses-distinct", F.size(F.array_distinct(u)) < F.size(u)),
        ("uses-safe", F.exists(u, text_unsafe)),
        ("notes-length", F.length(n) > 2000),
        ("notes-safe", text_unsafe(n)),
        ("basis", ~F.coalesce(b.isin(*BASES), F.lit(False))),
        ("approval-required", (b == "operator-approved-export") & (F.trim(ok) == "")),
        ("owner-required", (b == "account-owned-export") & (F.trim(own) == "")),
        ("identifier-length", (F.length(ok) > 200) | (F.length(own) > 200)),
        ("identifier-safe", text_unsafe(ok) | text_unsafe(own)),
        ("public-basis", (b == "public") & (a != "public")),
        ("licensed-basis", (b == "licensed-dataset") & (s != "licensed")),
        ("local-only", a.isin("paid-personal", "private", "unknown") & ~F.coalesce(F.col(local_only), F.lit(True))),
    ]
    return F.filter(F.array(*(F.when(F.coalesce(broken, F.lit(False)), F.lit(name)) for name, broken in rules)), lambda x: x.isNotNull())


def media_allowed(media_type: Column, consent: Column, allowed: tuple[str, ...] = ("image/*", "audio/*", "video/*", "application/pdf")) -> Column:
    """'stored' with consent and an allowed type, else what is missing."""
    return F.when(~F.coalesce(consent, F.lit(False)), "consent-required").when(~text.content_type_allowed(media_type, allowed), "type-not-allowed").otherwise("stored")
