"""Input views of the registered queries, over the driver's tables.

Each text runs unchanged in Spark and in DuckDB.
"""

CATALOG = """
SELECT n AS ordinal, product_id,
  concat(brand, ' ', gender, '''s ', color, ' ', fit, ' ', look, ' ', p_name) AS product_name,
  category, concat(look, ' ', p_name) AS subcategory, gender, color, size, fit, material,
  brand, price_inr, rating, season,
  concat('A ', lower(color), ' ', p_name, ' in ', lower(material), ' for ', lower(season), ' with a ', lower(fit), '.') AS description
FROM (SELECT p_partkey AS n, p_name,
  concat('PRD', CAST(p_partkey + 1001 AS STRING)) AS product_id,
  split_part('shirts,t-shirts,jeans,trousers,dresses,skirts,jackets,hoodies,sweaters,tops,shorts,ethnic wear,activewear', ',', CAST(p_partkey % 13 AS INT) + 1) AS category,
  split_part('Formal Classic,Casual Everyday,Party Evening,Summer Resort,Plain Basic', ',', CAST(((p_partkey * 23 + 1) % 113) % 5 AS INT) + 1) AS look,
  split_part('Men,Women,Unisex', ',', CAST(((p_partkey * 37 + 11) % 97) % 3 AS INT) + 1) AS gender,
  split_part('Black,Blue,White,Red,Green,Navy,Grey,Beige,Yellow,Pink,Olive,Maroon,Brown,Purple,Orange', ',', CAST(((p_partkey * 83 + 17) % 101) % 15 AS INT) + 1) AS color,
  split_part('S,M,L,XL,XXL', ',', CAST(p_size % 5 AS INT) + 1) AS size,
  split_part('Slim Fit,Regular Fit,Relaxed Fit,Oversized,Skinny Fit', ',', CAST(((p_partkey * 57 + 5) % 103) % 5 AS INT) + 1) AS fit,
  split_part('Cotton,Denim,Polyester,Linen,Wool,Silk,Rayon,Leather', ',', CAST(((p_partkey * 43 + 3) % 107) % 8 AS INT) + 1) AS material,
  p_brand AS brand,
  CAST(399 + ((p_partkey * 7919) % 112) * 50 AS DOUBLE) AS price_inr,
  round((35 + (p_partkey * 17) % 16) / 10e0, 1) AS rating,
  split_part('Summer,Winter,Spring,Autumn,All-Season', ',', CAST(((p_partkey * 29 + 7) % 109) % 5 AS INT) + 1) AS season
  FROM part) AS p
"""

# Search texts. {p} is a price that depends on the user.
TEMPLATES = (
    "blue slim fit jeans under {p}",
    "black casual t-shirts below {p}",
    "women's cotton dresses for summer",
    "men's oversized hoodies under {p}",
    "blue jeans under ₹{p}",
    "women's dresses below {p}",
    "cotton shirts",
    "party wear dresses",
    "casual clothes for summer",
    "jeans below rs. {p}",
    "jeans below INR {p}",
    "blue jeans under {p} rupees",
    "black tshirts below {p}",
    "womens dresses",
    "mens jeans",
    "party wear",
    "cotton shirts under ₹{p}",
    "shirts up to {p}",
    "jeans less than {p}",
    "JEANS UNDER {p}",
    "  Zara jackets ",
    "Nike shoes under {p}",
    "red cotton shirt for women",
    "sweaters under 10000",
    "comfortable clothes for travel",
    "formal wear under {p}",
    "I want something affordable",
    "activewear for gym",
    "summer party dress",
    "winter wool cardigan",
    "",
    "a",
    "xyz123abc!!!",
    "iPhone 15 Pro Max 256GB",
    "jeans under 10",
    "shirts under 500000",
    "space suit for Mars",
    "blu slm ft jens undr {p}",
    "Men's silk dress for summer",
    "black @#$% t-shirt <{p}>!",
    "I am looking for a beautiful blue color comfortable slim fit cotton denim jeans product for men under {p} INR for wearing in summer season",
    "men's dress shirts",
    "formal dress shirt for men",
    "yellow formal dress for men",
    "casual dress for men",
    "women's cotton dress",
    "can you recommend something blue for a man?",
    "recommend something stylish for a party",
    "jackets above {p}",
    "jeans between 1000 and 2,000",
    "jeans under 1999.99",
    "jeans from {p}",
    "unisex winter jackets",
    "oversized hoodies for boys",
    "maxi dress for men",
    "blue denim shirt",
    "1,00,000",
    "under {p}",
    "black casual t-shirts above ₹{p}",
    "show me a gray formal dress for men under {p}",
    "something for a wedding occasion",
    "office trousers {p}",
    "crop tops or less than {p} max",
    "olive linen kurta in spring",
)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# One row per event: who searched for what, and when.
SEARCH_LOG = f"""
SELECT event_id AS query_id, user_id, ts,
  replace(split_part({quoted('|'.join(TEMPLATES))}, '|', CAST(event_id % {len(TEMPLATES)} AS INT) + 1),
          '{{p}}', CAST(449 + 50 * (user_id % 112) AS STRING)) AS raw_query
FROM events
"""

# The same log with form choices on some searches.
FORM_LOG = f"""
SELECT query_id, raw_query,
  split_part('All,Men,Women,Unisex', ',', CAST(query_id % 7 % 4 AS INT) + 1) AS gender,
  split_part('All,All,jeans,shirts,dresses', ',', CAST(query_id % 11 % 5 AS INT) + 1) AS category,
  split_part('All,All,All,Blue,Black', ',', CAST(query_id % 13 % 5 AS INT) + 1) AS color,
  split_part('All,All,All,All,Slim Fit', ',', CAST(query_id % 17 % 5 AS INT) + 1) AS fit,
  split_part('All,All,All,All,Cotton', ',', CAST(query_id % 19 % 5 AS INT) + 1) AS material,
  CAST((query_id % 5) * 100 AS INT) AS low_price,
  CAST(6000 - (query_id % 3) * 1500 AS INT) AS high_price,
  split_part('4,10,0,-1,abc,7', ',', CAST(query_id % 6 AS INT) + 1) AS top_k
FROM ({SEARCH_LOG}) AS l
"""

# Answers as an outside service might give them: some cite ids beyond the
# evidence, some say too little, some are only blanks.
RESPONSE_LOG = """
SELECT event_id AS response_id,
  split_part('prd1001 suits the blue denim request well.|ok PRD1002|   |PRD1001 and PRD9999999 are close matches for this.|No supported product was found in the evidence.|PRD1003, prd1004 fit the request; xPRD77 does not.', '|', CAST(event_id % 6 AS INT) + 1) AS text,
  concat('PRD', CAST(1000 + event_id % 5 AS STRING)) AS id_a,
  concat('Prd', CAST(1003 + event_id % 2 AS STRING)) AS id_b
FROM events
"""

# The catalog as a careless export would hold it: text prices and ratings, padded
# and missing fields.
DIRTY_CATALOG = f"""
SELECT ordinal, product_id, concat(chr(160), ' ', product_name, chr(9)) AS product_name,
  CASE WHEN ordinal % 9 = 4 THEN 'NA' WHEN ordinal % 9 = 5 THEN CAST(NULL AS STRING) ELSE concat(' ', category) END AS category,
  subcategory, gender, CASE WHEN ordinal % 8 = 3 THEN 'N/A' ELSE color END AS color, size,
  CASE WHEN ordinal % 10 = 3 THEN 'None' ELSE fit END AS fit, material,
  CASE WHEN ordinal % 10 = 7 THEN 'na' ELSE brand END AS brand,
  CASE CAST(ordinal % 13 AS INT) WHEN 0 THEN '' WHEN 1 THEN 'abc' WHEN 2 THEN '1,999' WHEN 3 THEN 'NaN'
    WHEN 4 THEN '-5' WHEN 5 THEN '0' WHEN 6 THEN '1999d' WHEN 7 THEN ' 1499 ' WHEN 8 THEN '1e3'
    WHEN 9 THEN '.5' ELSE CAST(CAST(price_inr AS INT) AS STRING) END AS price_inr,
  CASE CAST(ordinal % 7 AS INT) WHEN 0 THEN '' WHEN 1 THEN 'good' WHEN 2 THEN CAST(NULL AS STRING)
    ELSE CAST(rating AS STRING) END AS rating,
  season, description
FROM ({CATALOG}) AS c
"""

# The catalog with repeated products: some rows come again, later, at another
# price, in another color or with another rating.
REPEATED_CATALOG = f"""
SELECT * FROM ({CATALOG}) AS c
UNION ALL
SELECT ordinal + 1000000 AS ordinal, product_id, product_name, category, subcategory, gender,
  CASE WHEN ordinal % 3 = 0 THEN 'Blue' ELSE color END AS color, size, fit, material, brand,
  CASE WHEN ordinal % 2 = 0 THEN price_inr + 1000 ELSE price_inr END AS price_inr,
  5e0 AS rating, season, description
FROM ({CATALOG}) AS c WHERE ordinal % 4 < 3
"""

# Products the order lines ask for.
WANTED = "SELECT concat('PRD', CAST(l_partkey + 1001 AS STRING)) AS product_id FROM lineitem"

# Vectors as an outside model might give them: each chunk and each search text borrows one.
CHUNK_VECTOR_NUMBER = "(CAST(substr(product_id, 4) AS BIGINT) * 7 + chunk_index * 31)"
