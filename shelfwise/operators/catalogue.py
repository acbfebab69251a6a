"""Catalogue filters, sorting, paging and top-k lists."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SORT_KEYS = ("price", "rating", "created_at")


def filter_products(products, active=True, type_=None, category=None, text=None, min_price=None, max_price=None) -> DataFrame:
    """Filter by state, category, substring of name or description, and price bounds; None means no filter."""
    for v in (min_price, max_price):
        if v is not None and v < 0:
            raise ValueError("price bounds must not be negative")
    if min_price is not None and max_price is not None and min_price > max_price:
        raise ValueError("min_price is above max_price")
    df = products
    if active is not None:
        df = df.where(F.col("is_active") == active)
    if type_:
        df = df.where(F.col("type") == type_)
    if category:
        df = df.where(F.col("category_name") == category)
    if text:
        hit = F.col("name").contains(text)
        if "description" in products.columns:
            hit = hit | F.col("description").contains(text)
        df = df.where(hit)
    if min_price is not None:
        df = df.where(F.col("price") >= min_price)
    if max_price is not None:
        df = df.where(F.col("price") <= max_price)
    return df


def sort_products(products, reviews=None, by="created_at", order="desc"):
    """The sort expressions and the frame they apply to; rating sorts keep unrated products last."""
    if by not in SORT_KEYS or order not in ("asc", "desc"):
        raise ValueError(f"cannot sort by {by} {order}")
    if by == "rating":
        avg = reviews.groupBy("product_id").agg(F.avg("rating").alias("rating"))
        products = products.join(avg, "product_id", "left")
    key = F.col(by).asc_nulls_last() if order == "asc" else F.col(by).desc_nulls_last()
    return products, [key, F.asc("product_id")]


def page_of(df: DataFrame, order, page=1, per_page=20) -> DataFrame:
    """One page; a page out of range is empty. Sort, offset and limit run as one bounded top-k."""
    if page < 1 or per_page < 1:
        raise ValueError("page and per_page start at 1")
    return df.orderBy(*order).offset((page - 1) * per_page).limit(per_page)


def with_page_counts(page_df: DataFrame, all_df: DataFrame, per_page) -> DataFrame:
    """Add the total and the number of pages to a page."""
    total = all_df.agg(F.count("*")).scalar()
    return page_df.withColumn("total", total).withColumn("pages", F.ceil(F.col("total") / per_page).cast("long"))


def keyset_page(df: DataFrame, order_col, id_col, after=None, per_page=20) -> DataFrame:
    """The page after ``(value, id)``, descending; its cost does not rise with the page number."""
    if after is not None:
        value, last_id = after
        df = df.where((F.col(order_col) < value) | ((F.col(order_col) == value) & (F.col(id_col) > last_id)))
    return df.orderBy(F.desc(order_col), F.asc(id_col)).limit(per_page)


def hot_products(products, category=None, k=6) -> DataFrame:
    """Newest active products."""
    df = filter_products(products, category=category)
    return df.orderBy(F.desc("created_at"), "product_id").limit(k)


def hot_by_sales(products, items, k=6) -> DataFrame:
    """Best-selling active products by units; sales are summed before the join."""
    sold = items.groupBy("product_id").agg(F.sum("quantity").alias("sold"))
    return products.where("is_active").join(sold, "product_id").orderBy(F.desc("sold"), "product_id").limit(k)


def top_per_group(df: DataFrame, keys, order, k) -> DataFrame:
    """First k rows per key; the row-number filter is pushed below the shuffle, so hot keys shrink map-side."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def seeded_sample(df: DataFrame, key, n, seed=42) -> DataFrame:
    """A fixed-size sample that depends only on the key and the seed."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def membership(left: DataFrame, right: DataFrame, keys, out) -> DataFrame:
    """Flag whether each row's keys occur in ``right``."""
    return left.join(right.select(*keys).distinct().withColumn(out, F.lit(True)), list(keys), "left").withColumn(
        out, F.coalesce(F.col(out), F.lit(False)))
