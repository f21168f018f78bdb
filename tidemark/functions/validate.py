"""Predicates on tickers, addresses, passwords and e-mail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Blocks of IPv4 that are not public, and beginnings of such IPv6 addresses in their short form.
PRIVATE = (
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16",
    "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4",
)
PRIVATE_6 = r"^(::1?$|::ffff:|64:ff9b:1:|100::|2001:(0|1?[0-9a-f]{1,2})?:|2001:db8:|2002:|f[cd][0-9a-f]{2}:|fe[89ab][0-9a-f]:)"
#: Addresses in these blocks that are public all the same (192.0.0.9, 192.0.0.10).
PUBLIC = (3221225481, 3221225482)
#: Fixed value: the signs that count in a password.
SIGNS = r"""[!@#$%^&*()\-_=+\[\]{};:'",.<>?/\\|`~]"""


def ticker(text: Column) -> Column:
    return F.upper(F.trim(text)).rlike(r"^[A-Z0-9.\-]{1,20}$")


def https_url(url: Column) -> Column:
    """HTTPS with a host and without credentials."""
    part = lambda p: F.try_parse_url(url, F.lit(p))
    return F.coalesce((F.lower(part("PROTOCOL")) == "https") & (part("HOST") != "") & part("USERINFO").isNull(), F.lit(False))


def ip_number(ip: Column) -> Column:
    p = F.split(ip, r"\.")
    return sum((F.get(p, i).try_cast("long") * (1 << (24 - 8 * i)) for i in range(1, 4)), F.get(p, 0).try_cast("long") * (1 << 24))


def public_ip4(ip: Column) -> Column:
    def outside(n: Column) -> Column:
        out = F.lit(True)
        for block in PRIVATE:
            base, bits = block.split("/")
            a, b, c, d = map(int, base.split("."))
            low = (a << 24) + (b << 16) + (c << 8) + d
            out = out & ~n.between(low, low + (1 << (32 - int(bits))) - 1)
        return out | n.isin(*PUBLIC)

    valid = ip.rlike(r"^((25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(\.|$)){4}$") & ~ip.endswith(".")
    return valid & F.forall(F.array(ip_number(ip)), outside)  # the number is worked out once


def public_ip(ip: Column) -> Column:
    """A valid address that is no private, loopback or link-local one. IPv6 addresses are expected in their short form; one that maps an IPv4 address counts as that."""
    bare = F.regexp_replace(ip, r"(?i)^::ffff:(?=[0-9]+\.)", "")
    six = bare.rlike(r"^[0-9A-Fa-f:]+$") & ~F.lower(bare).rlike(PRIVATE_6)
    return F.coalesce(F.when(bare.contains(":"), six).otherwise(public_ip4(bare)), F.lit(False))


def public_https(url: Column, ip: Column) -> Column:
    return https_url(url) & public_ip(ip)


def password_rules(password: Column, email: Column) -> Column:
    """struct of the policy's rules, each true where it holds."""
    local = F.lower(F.substring_index(email, "@", 1))
    return F.struct(
        F.length(password).between(14, 128).alias("length"), password.rlike("[a-z]").alias("lower"), password.rlike("[A-Z]").alias("upper"), password.rlike(r"\p{Nd}").alias("digit"), password.rlike(SIGNS).alias("sign"),
        (~password.rlike(r"(.)\1{3,}")).alias("no_runs"), (~((F.length(local) >= 4) & F.contains(F.lower(password), local))).alias("no_local_part"),
    )


def password_ok(password: Column, email: Column) -> Column:
    r = password_rules(password, email)
    return r["length"] & r["lower"] & r["upper"] & r["digit"] & r["sign"] & r["no_runs"] & r["no_local_part"]


def uncommon(passwords: DataFrame, common: DataFrame) -> DataFrame:
    """Rows whose password, in lower case, is not in common(password)."""
    return passwords.withColumn("_p", F.lower("password")).join(common.select(F.lower("password").alias("_p")).distinct(), "_p", "left_anti").drop("_p")


def strength(password: Column) -> Column:
    """0 for an empty text, else 1 to 4 by how many of six rules hold: length, upper, lower, digit, sign, no run of four."""
    rules = (F.length(password) >= 14, password.rlike("[A-Z]"), password.rlike("[a-z]"), password.rlike("[0-9]"), password.rlike(SIGNS), ~password.rlike(r"(.)\1{3,}"))
    n = sum((r.cast("int") for r in rules[1:]), rules[0].cast("int"))
    return F.when(F.length(password) == 0, 0).when(n <= 2, 1).when(n <= 4, 2).when(n == 5, 3).otherwise(4)


def unblocked(emails: DataFrame, blocked: DataFrame) -> DataFrame:
    """Rows whose e-mail's domain has a dot and is not in blocked(domain)."""
    domain = F.regexp_extract(F.lower(F.trim("email")), "^[^@]*@(.*)$", 1)  # all after the first @
    e = emails.withColumn("domain", domain).where(F.col("domain").contains(".") & F.col("email").contains("@"))
    return e.join(blocked, "domain", "left_anti")


def breach_count(passwords: DataFrame, ranges: DataFrame, fetched: DataFrame | None = None) -> DataFrame:
    """password_id, count: how often the feed (prefix, line = suffix:count) lists the password's SHA-1; 0 if it doesn't. If fetched(prefix) tells which ranges could be read, -1 for passwords of the others."""
    sha = F.upper(F.sha1(F.col("password").cast("binary")))
    parts = F.split("line", ":")
    feed = ranges.select("prefix", F.get(parts, 0).alias("suffix"), F.get(parts, 1).cast("long").alias("n"))
    p = passwords.select("password_id", F.left(sha, F.lit(5)).alias("prefix"), F.substring(sha, 6, 35).alias("suffix"))
    p = p.withColumn("known", F.lit(True)) if fetched is None else p.join(fetched.select("prefix", F.lit(True).alias("known")).distinct(), "prefix", "left")
    found = p.join(feed, ["prefix", "suffix"], "left").groupBy("password_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.every(F.coalesce("known", F.lit(False))).alias("known"))
    return found.select("password_id", F.when(F.col("known"), F.col("n")).otherwise(-1).alias("count"))


def time_zone(name: Column, known: tuple[str, ...]) -> Column:
    """Whether the name is one of the zones that are known (zoneinfo.available_timezones() of the deployment)."""
    return F.coalesce(name.isin(*known), F.lit(False))
