"""Schemas and fixed business values."""

from pyspark.sql import types as T

S, D, L, I = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType()


def struct(**cols):
    return T.StructType([T.StructField(k, v, True) for k, v in cols.items()])


INVOICE_CSV = struct(InvoiceNo=S, StockCode=S, Description=S, Quantity=I, InvoiceDate=S, UnitPrice=D,
                     CustomerID=S, Country=S)
LOAD_LOG_CSV = struct(timeStamp=L, elapsed=L, label=S, responseCode=S, success=S)
RFM = struct(user_id=L, recency=I, frequency=L, monetary=L, r_score=I, f_score=I, m_score=I, rfm_score=I, segment=S)
CHURN = struct(user_id=L, churn_prob=D, is_churn_risk=T.BooleanType(), top_features=S, model_name=S, status=S)
RULES = struct(antecedents=T.ArrayType(S), consequents=T.ArrayType(S), support=D, confidence=D, lift=D)
METRICS = struct(model_name=S, metric_name=S, metric_value=D, detail=S, created_at=T.TimestampType())
FORECAST = struct(pred_date=T.DateType(), pred_amount=D, pred_upper=D, pred_lower=D, model_name=S)

# Order states and the legal moves between them.
REVENUE_STATUSES = ("paid", "shipped", "delivered")
TRANSITIONS = [
    ("pending", "paid"), ("pending", "cancelled"),
    ("paid", "shipped"), ("paid", "refunded"), ("paid", "cancelled"),
    ("shipped", "delivered"),
]
CASE_STATUSES = ("pending", "contacted", "resolved")

# Segment names stored in result tables.
SEG_HIGH, SEG_POTENTIAL, SEG_GENERAL, SEG_AT_RISK, SEG_LOW = "高价值客户", "潜力客户", "一般客户", "流失预警", "低价值客户"
PROFILE_SEGMENTS = {"at_risk": "流失预警", "high": "高价值", "loyal": "忠诚", "potential": "潜力", "general": "一般"}
SEGMENT_ALIASES = {"Champions": "忠诚客户", "高价值忠诚客户": "高价值客户", "一般活跃客户": "活跃客户"}
CLUSTER_LABELS = {
    "outlier": "超多样化客户", "loyal": "忠诚客户", "high_loyal": "高价值忠诚客户", "active": "一般活跃客户",
    "deep_lost": "深度流失客户", "lost": "低频流失客户", "warning": "流失预警客户", "big_rare": "高消费低频客户",
    "new": "新客户", "plain": "普通客户",
}
SEGMENT_ADVICE = {
    SEG_HIGH: "您是我们的核心客户！感谢您的持续支持，我们将为您提供专属优惠。",
    SEG_POTENTIAL: "您有很高的消费潜力！看看我们的新品推荐，发现更多好物。",
    SEG_GENERAL: "感谢您的光临！参与我们的会员活动可享受更多优惠。",
    SEG_AT_RISK: "好久不见！我们为您准备了回归礼包，欢迎回来看看~",
    SEG_LOW: "欢迎光临！新用户可享受首单优惠。",
}
WEEKDAY_NAMES = ["周日", "周一", "周二", "周三", "周四", "周五", "周六"]
CATEGORY_OTHER = "其他"

# Keyword rules for product categories, tried in this order.
CATEGORY_KEYWORDS = {
    "BAG": ["bag", "tote", "satchel", "shopper"],
    "CANDLE & HOLDER": ["candle", "tealight", "holder"],
    "BAKING": ["muffin", "cake", "baking", "cupcake"],
    "CHRISTMAS": ["christmas", "xmas", "santa", "reindeer"],
    "HEART/LOVE": ["heart", "love"],
    "CLOCK & ALARM": ["clock", "alarm"],
    "BUNTING & FLAGS": ["bunting", "banner", "flag"],
    "STATIONERY": ["notebook", "journal", "diary", "pen", "pencil"],
    "METAL SIGN": ["metal", "sign", "plaque", "tin"],
    "FRAME": ["frame", "photo"],
    "STORAGE": ["jar", "bottle", "storage", "box", "basket"],
    "CUSHION & TEXTILE": ["cushion", "pillow", "towel"],
    "POUCH & PURSE": ["pouch", "purse", "wallet"],
    "LANTERN & LIGHT": ["lantern", "lamp", "light"],
    "VINTAGE": ["vintage", "retro", "antique"],
    "LUNCH BOX": ["lunch box", "lunch bag"],
    "TEACUP": ["teacup", "tea cup", "saucer"],
    "TOY & GAME": ["doll", "teddy", "toy", "game", "puzzle"],
    "ORNAMENT": ["ornament", "decoration", "hanging"],
    "KITCHEN": ["kitchen", "cooking", "utensil"],
}
CATEGORY_DEFAULT = "HOME DECOR & OTHER"
CATEGORY_NAMES = {
    "BAG": "箱包", "CANDLE & HOLDER": "蜡烛与烛台", "BAKING": "烘焙", "CHRISTMAS": "圣诞装饰", "HEART/LOVE": "爱心礼品",
    "CLOCK & ALARM": "钟表闹钟", "BUNTING & FLAGS": "彩旗与旗帜", "STATIONERY": "文具", "METAL SIGN": "金属标牌",
    "FRAME": "相框", "STORAGE": "收纳", "CUSHION & TEXTILE": "靠垫与纺织品", "POUCH & PURSE": "小包与钱包",
    "LANTERN & LIGHT": "灯笼与灯具", "VINTAGE": "复古", "LUNCH BOX": "饭盒", "TEACUP": "茶杯",
    "TOY & GAME": "玩具与游戏", "ORNAMENT": "装饰品", "KITCHEN": "厨房用品",
}
CATEGORY_NAME_DEFAULT = "家居装饰与其他"

# First and last names for pseudonyms.
FIRST_NAMES = ["Alice", "Bob", "Charlie", "Diana", "Eve", "Frank", "Grace", "Henry", "Ivy", "Jack"]
LAST_NAMES = ["Smith", "Johnson", "Williams", "Brown", "Jones", "Garcia", "Miller", "Davis", "Rodriguez", "Martinez"]
EMAIL_PREFIX, EMAIL_SUFFIX = "customer_", "@customers.example"

# Bank holidays and sale days used by the sales calendar, per year.
HOLIDAYS = [
    "2010-01-01", "2010-04-02", "2010-04-05", "2010-05-03", "2010-05-31", "2010-08-30", "2010-12-27", "2010-12-28",
    "2011-01-03", "2011-04-22", "2011-04-25", "2011-05-02", "2011-05-30", "2011-08-29", "2011-12-26", "2011-12-27",
    "2010-11-26", "2011-11-25", "2010-12-25", "2011-12-25", "2010-11-11", "2011-11-11",
]

# Columns watched for drift.
CLUSTER_MONITOR = ["recency_days", "total_orders", "total_spent", "unique_products", "avg_spend_per_order",
                   "avg_items_per_order", "weekend_ratio"]
CHURN_MONITOR = ["recency_days", "total_spent", "total_orders", "unique_products", "avg_item_price",
                 "avg_purchase_hour", "tenure_days", "order_frequency", "product_diversity", "avg_spend_per_order"]
CLUSTER_FEATURES = ["r_quintile", "f_quintile", "m_quintile", "product_diversity", "is_bulk_buyer",
                    "purchase_velocity", "activity_rate", "weekend_ratio", "avg_spend_per_order", "total_orders",
                    "recency_days"]
