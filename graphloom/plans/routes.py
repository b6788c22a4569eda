"""The theta join of routes, as equi-joins on what must be equal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import routes_match


def matched(clients: DataFrame, servers: DataFrame) -> DataFrame:
    """(client, server) of all routes that match (`route` columns, normalised); null routes match nothing.

    The form of a route is the places of its `*`. Two routes of equal length match if they are equal in the
    places where neither has one. So for each form on the other side a route has a key, its parts in those
    places, and meets what has the same key for the same two forms. Of unequal lengths, the shorter ends in
    `*`, and what is before that meets the longer's first parts in the same way. A pair meets once, and only if it matches:
    the work is a row a route and form on the other side, and a row a match. Forms are those that the routes have.
    """

    def sides(df: DataFrame, name: str) -> DataFrame:
        return df.filter("route IS NOT NULL").select(F.col("route").alias(name), F.split("route", "/").alias("p")).distinct()

    form = lambda p: F.array_join(F.transform(p, lambda x: F.when(x == "*", "*").otherwise(".")), "")
    size = F.size("p")

    def keyed(x: DataFrame, other: DataFrame, flip: bool) -> DataFrame:
        """x (form, parts) for each form of the other side of the same length."""
        both = x.join(F.broadcast(other.select(F.col("form").alias("met")).distinct()), F.length("form") == F.length("met"))
        open_ = lambda v, i: (v != "*") & (F.substr("met", i + 1, F.lit(1)) == ".")
        key = F.transform("parts", lambda v, i: F.when(open_(v, i), v).otherwise("*"))
        pair = F.concat_ws("|", *(("met", "form") if flip else ("form", "met")))
        return both.withColumns({"k": F.array_join(key, "/"), "forms": pair}).drop("form", "met", "parts", "p")

    def meet(x: DataFrame, y: DataFrame) -> DataFrame:
        return keyed(x, y, False).join(keyed(y, x, True), ["forms", "k"]).select("client", "server")

    def whole(df: DataFrame) -> DataFrame:
        return df.withColumns({"form": form(F.col("p")), "parts": F.col("p")})

    def starts(df: DataFrame) -> DataFrame:
        """What is before the `*` at the end of each route."""
        some = df.filter(F.element_at("p", -1) == "*").withColumn("parts", F.slice("p", 1, size - 1))
        return some.withColumn("form", form(F.col("parts")))

    def heads(df: DataFrame, lengths: DataFrame) -> DataFrame:
        """The first parts of each route, as many as some shorter route that ends in `*` has before that."""
        some = df.join(F.broadcast(lengths), F.col("m") < size - 1).withColumn("parts", F.slice("p", F.lit(1), F.col("m"))).drop("m")
        return some.withColumn("form", form(F.col("parts")))

    def shorter(x: DataFrame, y: DataFrame) -> DataFrame:
        short = starts(x)
        return meet(short, heads(y, short.select(F.size("parts").alias("m")).distinct()))

    c, s = sides(clients, "client"), sides(servers, "server")
    out = meet(whole(c), whole(s)).unionByName(shorter(c, s)).unionByName(shorter(s, c))
    return out.filter(routes_match(F.col("client"), F.col("server")))
