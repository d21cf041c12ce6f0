"""Card invoices: totals, owners, installments, backfills and get-or-create keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.money import MONEY, total
from tallyspark.functions.shared import clustered, discard, parts, saved
from tallyspark.functions.sizes import grows


def invoice_net_totals(installments: DataFrame, tx: DataFrame) -> DataFrame:
    """Expenses less everything else, by invoice."""
    rows = installments.select("invoice_id", "transaction_id").join(tx.select(F.col("tx_id").alias("transaction_id"), "type", "amount"), "transaction_id")
    return rows.groupBy("invoice_id").agg(total(F.when(F.col("type") == "EXPENSE", F.col("amount")).otherwise(-F.col("amount"))).alias("net_total"), F.count("*").alias("n_installments"))


def invoice_summary(invoices: DataFrame, cards: DataFrame, persons: DataFrame, net: DataFrame, as_of: str) -> DataFrame:
    """Each live invoice with card, holder (cardholder, else owner, else empty), the total to show
    (the stored one if positive, else the net one), and whether it is paid or overdue."""
    holder = F.coalesce(F.nullif(F.trim("cardholder_name"), F.lit("")), F.nullif(F.trim("owner_name"), F.lit("")), F.lit(""))
    return (
        invoices.where("deleted_at is null")
        .join(cards, "card_id", "left")
        .join(persons.select(F.col("person_id").alias("owner_id"), F.col("name").alias("owner_name")), "owner_id", "left")
        .join(net, "invoice_id", "left")
        .select(
            "invoice_id", "card_id", "owner_id", holder.alias("holder"),
            F.when(F.col("total_amount") > 0, F.col("total_amount")).otherwise(F.coalesce("net_total", F.lit(0))).cast(MONEY).alias("display_total"),
            (F.col("status") == "PAID").alias("is_paid"), ((F.col("status") != "PAID") & (F.col("due_date") < F.lit(as_of).cast("date"))).alias("is_overdue"),
        )
    )


def monthly_invoices(invoices: DataFrame) -> DataFrame:
    """One row per card and month."""
    return invoices.where("deleted_at is null").groupBy("card_id", "year", "month").agg(F.sum("total_amount").cast(MONEY).alias("total"), F.min("invoice_id").alias("invoice_id"))


def month_over_month(monthly: DataFrame) -> DataFrame:
    """The change against the calendar month before, at six decimals; null without one, or if it was 0."""
    now = monthly.withColumn("idx", F.col("year") * 12 + F.col("month"))
    before = now.select("card_id", (F.col("idx") + 1).alias("idx"), F.col("total").alias("previous"))
    change = F.round((F.col("total") - F.col("previous")) / F.nullif(F.col("previous"), F.lit(0)), 6).cast("decimal(19,6)")
    return now.join(before, ["card_id", "idx"], "left").select("card_id", "year", "month", "total", "previous", change.alias("change"))


def outstanding_debt(invoices: DataFrame, cards: DataFrame) -> DataFrame:
    """What open invoices still ask for, by owner; overpaid ones count 0."""
    open_ = invoices.where("deleted_at is null and status = 'OPEN'").join(cards.select("card_id", "owner_id"), "card_id")
    return open_.groupBy("owner_id").agg(total(F.greatest(F.col("total_amount") - F.col("paid_amount"), F.lit(0))).alias("outstanding"))


def invoice_insights(installments: DataFrame, tx: DataFrame, hints: list[str]) -> DataFrame:
    """By invoice: spending by category as a map, the highest expense, and descriptions that look like subscriptions, sorted."""
    rows = installments.select("invoice_id", F.col("transaction_id").alias("tx_id")).distinct().join(tx.where("type = 'EXPENSE'"), "tx_id")
    spend = rows.groupBy("invoice_id", F.coalesce(F.nullif(F.trim("category"), F.lit("")), F.lit("Outros")).alias("category")).agg(F.sum("amount").cast(MONEY).alias("spent"))
    maps = spend.groupBy("invoice_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "spent")))).alias("by_category"))
    wanted = F.lower("description").rlike("|".join(hints))
    top = rows.groupBy("invoice_id").agg(
        F.max("amount").alias("highest_amount"),
        F.max_by("description", F.struct(F.col("amount"), -F.col("line_no"), F.col("description"))).alias("highest_description"),
        F.array_sort(F.collect_set(F.when(wanted, F.lower("description")))).alias("subscriptions"),
    )
    return top.join(maps, "invoice_id")


def latest_invoice(invoices: DataFrame, cards: DataFrame) -> DataFrame:
    """The newest invoice of each owner, and the earliest due date."""
    owned = invoices.where("deleted_at is null").join(cards.select("card_id", "owner_id"), "card_id")
    order = F.struct("year", "month", -F.col("invoice_id"))
    return owned.groupBy("owner_id").agg(F.max_by("invoice_id", order).alias("latest_invoice_id"), F.min("due_date").alias("first_due"))


def cascade_delete(tx: DataFrame, installments: DataFrame, invoices: DataFrame) -> DataFrame:
    """Transactions with the deletion of their invoice, where they weren't deleted before."""
    gone = installments.join(invoices.where("deleted_at is not null").select("invoice_id", F.col("deleted_at").alias("invoice_deleted")), "invoice_id")
    dates = gone.groupBy(F.col("transaction_id").alias("tx_id")).agg(F.min("invoice_deleted").alias("invoice_deleted"))
    return tx.join(dates, "tx_id", "left").withColumn("deleted_at", F.coalesce("deleted_at", "invoice_deleted")).drop("invoice_deleted")


def backfill_reference_month(tx: DataFrame, installments: DataFrame) -> DataFrame:
    """Sets the purchase date, where it is missing, to the old transaction date, and the transaction date to the
    installment's due date (the first of several), for rows where the two differ; null-safe."""
    due = installments.groupBy(F.col("transaction_id").alias("tx_id")).agg(F.min("due_date").alias("new_date"))
    joined = tx.join(due, "tx_id", "left")
    changes = F.col("new_date").isNotNull() & ~F.col("transaction_date").eqNullSafe(F.col("new_date"))
    return joined.select(
        *[c for c in tx.columns if c not in ("transaction_date", "purchase_date")],
        F.when(changes, F.coalesce("purchase_date", "transaction_date")).otherwise(F.col("purchase_date")).alias("purchase_date"),
        F.when(changes, F.col("new_date")).otherwise(F.col("transaction_date")).alias("transaction_date"),
        changes.alias("changed"),
    )


#: What a card has that a batch makes; fixed values.
CARD_DEFAULTS = {"limit_amount": 10_000, "closing_day": 5, "due_day": 15}


def card_keys(name: Column, brand: Column, last_four: Column) -> list[Column]:
    """What cards are compared by: brand b and name n in lower case, each the other where it is missing, and last digits d, null without."""
    text = lambda x: F.nullif(F.trim(x.cast("string")), F.lit(""))
    return [F.lower(F.coalesce(text(brand), text(name), F.lit(""))).alias("b"), F.lower(F.coalesce(text(name), text(brand), F.lit(""))).alias("n"), text(last_four).alias("d")]


#: What cards and rows that may be the same card have in common; all that is joined, grouped or ranked here is so by these and more.
CARD_PARTS = ["owner_id", "b"]


def card_hits(first: DataFrame, cards: DataFrame, more: tuple[str, ...] = ()) -> tuple[dict[str, DataFrame], DataFrame]:
    """({d, n}: the card of each owner, brand and digits or name, new cards), as resolve_cards finds them for first (owner_id, b, d, n, at), whose
    rows may repeat. A card is (card: card_id and what more names, since): since is the `at` that makes a new one, null for one there was.
    If first is clustered by CARD_PARTS, or made of such a table, it isn't shuffled; hits are parted so."""
    c, n = F.col, parts(first.sparkSession)
    known = cards.select("owner_id", F.struct("card_id", *more).alias("card"), F.lower(F.trim("brand")).alias("b"), F.lower(F.trim("name")).alias("n"), c("last_four").cast("string").alias("d"))
    known = known.repartition(n, *CARD_PARTS)
    old = {k: known.where(c(k).isNotNull()).groupBy(*CARD_PARTS, k).agg(F.min("card").alias("card")) for k in ("d", "n")}
    left = first.join(grows(old["d"]), [*CARD_PARTS, "d"], "left_anti").join(grows(old["n"]), [*CARD_PARTS, "n"], "left_anti")
    left = left.groupBy(*CARD_PARTS, "d", "n").agg(F.min("at").alias("at")).withColumn("makes", F.lit(False))
    left, made = clustered(left, "cards-left", *CARD_PARTS, parted=True), []
    by = {k: Window.partitionBy(*CARD_PARTS, k) for k in ("d", "n")}
    card = ["owner_id", "b", "d", "n", "at"]
    while not left.where("not makes").isEmpty():
        here = left.where("not makes").withColumn("n_at", F.min("at").over(by["n"])).withColumn("d_at", F.min("at").over(by["d"]))
        here = here.withColumn("makes", F.expr("at = n_at and (d is null or at = d_at)"))
        here = here.withColumn("d_gone", c("d").isNotNull() & F.max("makes").over(by["d"])).withColumn("n_gone", F.max("makes").over(by["n"]))
        here = clustered(here.where("makes or not (d_gone or n_gone)").select(*card, "makes"), "cards-left", *CARD_PARTS, parted=True)
        made.append(saved(here.where("makes").select(*card), "cards-made"))
        discard(left)
        left = here
    new = reduce(lambda a, b: a.unionByName(b), made, left.where("not makes").select(*card))
    hits = {}
    for k in ("d", "n"):
        found = old[k].withColumn("since", F.lit(None).cast(first.schema["at"].dataType)).unionByName(new.where(c(k).isNotNull()).select(*CARD_PARTS, k, F.lit(None).cast(known.schema["card"].dataType).alias("card"), c("at").alias("since")))
        hits[k] = found.select(*CARD_PARTS, k, F.struct("card", "since").alias(f"by_{k}")).repartition(n, *CARD_PARTS)
    return hits, new


def card_of(at: Column, card: str) -> Column:
    """(how, card, since) of a row that is first for its keys, by the hits by_d and by_n: card is a type."""
    before = lambda hit: hit.isNotNull() & (hit["since"].isNull() | (hit["since"] < at))
    one = lambda how, x: F.struct(F.lit(how).alias("how"), x["card"].alias("card"), x["since"].alias("since"))
    found = F.when(before(F.col("by_d")), one("digits", F.col("by_d"))).when(before(F.col("by_n")), one("name", F.col("by_n")))
    return F.coalesce(found, F.struct(F.lit("new").alias("how"), F.lit(None).cast(card).alias("card"), at.alias("since")))


def resolve_cards(rows: DataFrame, cards: DataFrame) -> DataFrame:
    """rows (row_id, owner_id, name, brand, last_four; upload and place where uploads have several rows) with a card: the first of the
    owner's with the same brand and last digits, else the first with the same brand and name, else a new one, which later
    rows find in turn. Brands and names are compared without case; a missing name is the brand, a missing brand the name.

    Uploads come in the order of `upload`, their rows in that of `place`, then row_id. Within an upload, rows with the brand and last digits
    (the name, where there are none) of an earlier row have that row's card. Cards there are come first, by id.
    Result: row_id, card_id (null: a new card), made_by (the row that makes the new card), matched_by (upload, digits, name or new).

    A row makes a card when neither its digits nor its name are taken before it, and then takes both. So the rows that do are
    those that, of all that are left, come first for both of their keys; rows whose keys they take are done, and the rest goes
    another round. Rounds are as many as such rows wait for each other in a chain; each is a few ranks over what differs in brand, digits or name. Rows are shuffled
    and written once, by owner and brand, with the first row of their card in their upload; one owner's rows of one brand are sorted in one task, and never held.
    """
    c = F.col
    for name in ("upload", "place"):
        if name not in rows.columns:
            rows = rows.withColumn(name, c("row_id"))
    own = rows.select("row_id", "owner_id", "upload", "place", *card_keys(c("name"), c("brand"), c("last_four")))
    own = own.repartition(parts(rows.sparkSession), *CARD_PARTS)
    first = F.min(F.struct("place", "row_id", "n", "d")).over(Window.partitionBy("owner_id", "upload", "b", F.coalesce("d", "n")))
    own = own.withColumn("first", first)
    same = c("place").eqNullSafe(c("first.place")) & (c("row_id") == c("first.row_id"))
    # where a row comes first itself, what is first is told by its own columns
    own = own.select("row_id", "owner_id", "upload", "place", "b", c("first.n").alias("n"), c("first.d").alias("d"), F.when(~same, F.struct("first.place", "first.row_id")).alias("first"))
    own = clustered(own, "card-rows", *CARD_PARTS, parted=True)
    keys = [*CARD_PARTS, "d", "n"]
    firsts = own.where("first is null").groupBy(*keys).agg(F.min(F.struct("upload", "place", "row_id")).alias("at"))
    hits, _ = card_hits(firsts, cards)
    met = own.join(grows(hits["d"]), [*CARD_PARTS, "d"], "left").join(grows(hits["n"]), [*CARD_PARTS, "n"], "left")
    alone = c("first").isNull()
    at = F.struct("upload", F.when(alone, c("place")).otherwise(c("first.place")).alias("place"), F.when(alone, c("row_id")).otherwise(c("first.row_id")).alias("row_id"))
    hit = card_of(c("at"), hits["d"].schema["by_d"].dataType["card"].dataType.simpleString())
    found = met.withColumn("at", at).select("row_id", alone.alias("alone"), hit.alias("hit"))
    return found.select("row_id", c("hit.card.card_id").alias("card_id"), c("hit.since")["row_id"].alias("made_by"), F.when(c("alone"), c("hit.how")).otherwise("upload").alias("matched_by"))


def card_defaults() -> list[Column]:
    return [F.lit(v).cast(MONEY if k == "limit_amount" else "int").alias(k) for k, v in CARD_DEFAULTS.items()]


def new_cards(rows: DataFrame, resolved: DataFrame) -> DataFrame:
    """The cards that resolved rows make: made_by, owner_id, name, brand and last_four of the row that makes each, and defaults."""
    own = resolved.where("matched_by = 'new'").select("row_id").join(rows, "row_id")
    name, brand = F.nullif(F.trim("name"), F.lit("")), F.nullif(F.trim("brand"), F.lit(""))
    return own.select(F.col("row_id").alias("made_by"), "owner_id", F.coalesce(name, brand).alias("name"), F.coalesce(brand, name).alias("brand"), "last_four", *card_defaults())


def upsert_invoices(rows: DataFrame, existing: DataFrame, key: tuple[str, ...] = ("card_id",)) -> DataFrame:
    """Invoices to insert or update by key, month and year: new sums are added to those there are. The key is the card;
    for banks that bill all cards of a user together it is (bank, user_id)."""
    by = [*key, "year", "month"]
    fresh = rows.groupBy(*by).agg(F.sum("amount").cast(MONEY).alias("added"), F.max("due_date").alias("new_due"))
    old = existing.groupBy(*by).agg(F.sum("total_amount").cast(MONEY).alias("before"), F.min("due_date").alias("old_due"))
    joined = fresh.join(old, by, "full_outer")
    action = F.when(F.col("before").isNull(), "insert").when(F.col("added").isNull(), "keep").otherwise("update")
    return joined.select(*by, (F.coalesce("before", F.lit(0)) + F.coalesce("added", F.lit(0))).cast(MONEY).alias("total"), F.coalesce("old_due", "new_due").alias("due_date"), action.alias("action"))


def recategorize(tx: DataFrame, updates: DataFrame) -> DataFrame:
    """Applies updates (person_id, tx_id, new_category, new_scope) to the owner's rows; blank ones change nothing."""
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    one = updates.groupBy("person_id", "tx_id").agg(F.max(some("new_category")).alias("new_category"), F.max(some("new_scope")).alias("new_scope"))
    out = tx.join(one, ["person_id", "tx_id"], "left")
    return out.withColumn("category", F.coalesce("new_category", "category")).withColumn("scope", F.coalesce("new_scope", "scope")).drop("new_category", "new_scope")


def apply_trip(tx: DataFrame, chosen: DataFrame) -> DataFrame:
    """Marks chosen (person_id, tx_id, trip_id) expenses that have no trip yet: category Viagem; the sub-category stays
    where there is one, else it is the old category. All other rows stay as they are. Of several trips the first by id."""
    have = lambda c: F.col(c) if c in tx.columns else F.lit(None).cast("string")
    one = chosen.groupBy("person_id", "tx_id").agg(F.min("trip_id").alias("new_trip"))
    joined = tx.join(one, ["person_id", "tx_id"], "left").withColumn("__trip", have("trip_id"))
    hit = (F.col("type") == "EXPENSE") & F.col("new_trip").isNotNull() & F.col("__trip").isNull()
    out = joined.withColumn("trip_subcategory", F.when(hit, F.coalesce(have("trip_subcategory"), "category")).otherwise(have("trip_subcategory")))
    out = out.withColumn("trip_id", F.when(hit, F.col("new_trip")).otherwise(F.col("__trip")))
    return out.withColumn("category", F.when(hit, "Viagem").otherwise(F.col("category"))).drop("new_trip", "__trip")
