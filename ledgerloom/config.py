"""Names, lists and patterns that must be as they are for the results to be right."""

# fixed values: tokens of a missing key part
MISSING = "<MISSING>"
# fixed values: day
DAY = 86_400

# fixed values: mail domains that identify nobody
GENERIC_MAIL = ("anonymous.com", "mail.com", "<MISSING>")

# fixed values: first and last number of the V columns that are empty or filled together
V_BLOCKS = ((1, 11), (12, 34), (35, 52), (53, 74), (75, 94), (95, 137),
            (138, 166), (167, 216), (217, 278), (279, 321), (322, 339))

# fixed values: forward folds in days as (history end, validation start, validation end)
PURGED_FOLDS = ((15, 45, 60), (30, 60, 75), (45, 75, 90), (60, 90, 106))
# fixed values: stack folds
STACK_FOLDS = ((30, 60, 75), (45, 75, 90), (60, 90, None))

# fixed values: back-test pairs as (name, stage, horizon, history end, validation start, validation end)
DEV_PAIRS = (("dev_h30_a", "dev", 30, 15, 45, 60), ("dev_h30_b", "dev", 30, 30, 60, 75),
             ("dev_h30_c", "dev", 30, 45, 75, 90), ("dev_h45_a", "dev", 45, 15, 60, 75),
             ("dev_h45_b", "dev", 45, 30, 75, 90), ("dev_h60", "dev", 60, 15, 75, 90))
# fixed values: lock pairs
LOCK_PAIRS = (("lock_h30", "lock", 30, 60, 90, 106), ("lock_h45", "lock", 45, 45, 90, 106),
              ("lock_h60", "lock", 60, 30, 90, 106), ("lock_h75", "lock", 75, 15, 90, 106))
# fixed values: segments
SEGMENTS = ("strict", "partial", "cold")

# fixed values: velocity windows in seconds
VELOCITY = {"1h": 3_600, "6h": 21_600, "1d": 86_400, "7d": 604_800, "30d": 2_592_000}
# fixed values: velocity sums
VELOCITY_SUMS = ("1d", "7d")

# fixed values: counter ratios
COUNTER_RATIOS = (("C1", "C2"), ("C1", "C14"), ("C2", "C14"), ("C5", "C9"), ("C6", "C8"),
                  ("C10", "C13"), ("C11", "C13"), ("C12", "C13"))

# fixed values: a later pattern wins over an earlier one
DEVICE_BRANDS = (("windows|trident|^rv:", "windows"), ("ios|iphone|ipad", "apple_ios"),
                 ("macos|mac os", "apple_mac"), ("^sm-|^gt-|^sch-|^sgh-", "samsung"),
                 ("huawei|^ale-|^ane-|^bla-|^vns-", "huawei"), ("redmi|xiaomi|^mi ", "xiaomi"),
                 ("^lg-|^lg$", "lg"), ("moto|motorola", "motorola"), ("pixel|nexus", "google"),
                 ("htc", "htc"), ("zte", "zte"))
# fixed values: mobile device
MOBILE_DEVICE = "android|ios|iphone|ipad|^sm-|moto|huawei|redmi|xiaomi"
# fixed values: mobile browser
MOBILE_BROWSER = "mobile|android|ios"

# fixed values: key columns and largest group size of the two entity graphs
GRAPH_KEYS = ((("card1", "addr1", "origin"), 200), (("card1", "origin", "P_emaildomain"), 200),
              (("card1", "card2", "card3", "card5", "origin"), 150), (("card1", "addr1", "origin", "DeviceInfo"), 100))
# fixed values: graph2 keys
GRAPH2_KEYS = ((("card1", "addr1", "origin"), 200), (("card1", "origin", "clean_email"), 150),
               (("card1", "card2", "card3", "card5", "origin"), 150))
# fixed values: component cap
COMPONENT_CAP = 500

# fixed values: membership groups as name -> (key columns, largest group that is pooled)
MEMBERSHIP = {"strict_clean_email": (("card1", "addr1", "origin", "clean_email"), 500),
              "card_addr_origin": (("card1", "addr1", "origin"), 500),
              "card_origin_clean_email": (("card1", "origin", "clean_email"), 250),
              "card_full_origin": (("card1", "card2", "card3", "card5", "origin"), 250),
              "card_addr_origin_product": (("card1", "addr1", "origin", "ProductCD"), 500),
              "origin_clean_email": (("origin", "clean_email"), 150)}

# fixed values: raw columns a meta model may see, by name, by pattern, by prefix of a frequency column
RAW_NAMES = ("TransactionAmt", "TransactionAmt_log1p", "TransactionAmt_cents", "TransactionAmt_is_integer",
             "TransactionAmt_is_round_10", "ProductCD", "addr1", "addr2", "dist1", "dist2", "P_emaildomain",
             "R_emaildomain", "P_R_email_match", "P_email_suffix", "R_email_suffix", "DeviceType", "DeviceInfo",
             "DeviceInfo_family", "browser_family", "DT_hour", "DT_dayofweek", "D1_origin_day",
             "row_missing_count", "C_mean", "C_std", "C_min", "C_max", "D_missing_count", "D_mean", "D_std",
             "D_min", "D_max", "V_missing_count", "V_mean", "V_std", "V_min", "V_max",
             "id_numeric_missing_count", "id_numeric_mean", "id_numeric_std", "id_numeric_min", "id_numeric_max")
# fixed values: raw patterns
RAW_PATTERNS = (r"card[1-6]", r"C([1-9]|1[0-4])", r"D([1-9]|1[0-5])(_minus_day)?", r"M[1-9]",
                r"id_(0[1-9]|[12]\d|3[0-8])", r"uid_(d1|card_addr_d1)_email_seq_.*",
                r"(card|addr|P_email|R_email|Device|uid_).*_freq")
# fixed values: unstable v
UNSTABLE_V = (322, 339)

# fixed values: V columns with statistics inside an entity, in order of importance
TOP_V = ("V242", "V243", "V258", "V265", "V199", "V201", "V257", "V274", "V86", "V156", "V44", "V87", "V62", "V217", "V91",
         "V67", "V275", "V189", "V212", "V70", "V61", "V69", "V45", "V149", "V256", "V90", "V266", "V94", "V308", "V200")
# fixed values: profile numbers
PROFILE_NUMBERS = ("dist1", "dist2", "D1", "D3", "C1", "C2", "C13", "C14", "V279", "V280", "V306", "V307", "V308")
# fixed values: profile ranges
PROFILE_RANGES = ("V279", "V280", "V306", "V307", "V308")
# fixed values: profile ids
PROFILE_IDS = ("card1", "card2", "card5", "addr1", "P_emaildomain", "R_emaildomain", "DeviceInfo", "ProductCD")
# fixed values: memory columns
MEMORY_COLUMNS = ("addr1", "P_emaildomain", "R_emaildomain", "DeviceInfo", "ProductCD", "card2", "card5")
# fixed values: behavior columns
BEHAVIOR_COLUMNS = ("ProductCD", "card2", "card5", "addr1", "P_emaildomain", "R_emaildomain", "DeviceInfo", "id_30", "id_31", "id_33")
# fixed values: pairs
PAIRS = (("card1", "addr1"), ("card1", "P_emaildomain"), ("card1", "DeviceInfo"), ("P_emaildomain", "DeviceInfo"),
         ("id_30", "id_31"), ("card4", "card6"))
# fixed values: amount keys
AMOUNT_KEYS = {"card1": ("card1",), "card1_addr1": ("card1", "addr1"), "card1_product": ("card1", "ProductCD"),
               "card1_card5": ("card1", "card5"), "card1_register": ("card1", "D1_origin_day"), "product_card4": ("ProductCD", "card4")}
# fixed values: coarse keys
COARSE_KEYS = {"uid_card_addr": ("card1", "addr1"), "uid_card_email": ("card1", "addr1", "P_emaildomain"),
               "uid_card_full": ("card1", "card2", "card3", "card5"), "uid_card_device": ("card1", "addr1", "DeviceInfo"),
               "uid_email_pair": ("P_emaildomain", "R_emaildomain")}
# fixed values: origin keys
ORIGIN_KEYS = ("uid_d1_email", "uid_card_addr_d1", "uid_card_addr_d1_email")
# fixed values: frequency columns
FREQUENCY_COLUMNS = ("card1", "card2", "card3", "card4", "card5", "card6", "addr1", "addr2", "P_emaildomain", "R_emaildomain",
                     "DeviceInfo", "DeviceInfo_family", *COARSE_KEYS, *ORIGIN_KEYS)
