"""Input views over the given tables.  Each is one SQL text that Spark and DuckDB both run, over whole tables."""

MCQ = """
SELECT event_id AS idx, 'm' || CAST(user_id % 4 AS STRING) AS model,
  CASE WHEN event_id % 3 = 0 THEN 'test' ELSE 'dev' END AS split,
  event_type AS l2_category, 'cat' || CAST(user_id % 5 AS STRING) AS category,
  'cycle' || CAST(event_id % 4 AS STRING) AS cycle_category,
  CASE event_id % 3 WHEN 0 THEN 'Reasoning/' ELSE 'Perception/' END
    || CASE event_id % 4 WHEN 0 THEN 'Monitoring' WHEN 1 THEN 'Remote Sensing' ELSE 'Diagram and Table' END AS task_path,
  CASE event_id % 5 WHEN 0 THEN 'Vehicle/Attribute/color' WHEN 1 THEN 'Count' ELSE 'Position/' || event_type END AS sub_path,
  'What happened in session ' || CAST(user_id AS STRING) AS question,
  'red ' || event_type AS A, 'green ' || event_type AS B, 'blue ' || event_type AS C,
  CASE WHEN event_id % 6 = 5 THEN NULL ELSE 'grey ' || event_type END AS D,
  substr('ABCD', CAST(event_id % 3 AS INT) + 1, 1) AS answer,
  CASE event_id % 11
    WHEN 0 THEN 'Answer: ' || substr('ABCD', CAST(event_id % 4 AS INT) + 1, 1)
    WHEN 1 THEN 'The answer is (B).'
    WHEN 2 THEN 'A or B'
    WHEN 3 THEN 'Z'
    WHEN 4 THEN 'It shows the GREEN ' || event_type
    WHEN 5 THEN 'Failed to obtain answer via API.'
    WHEN 6 THEN 'Cannot determine the answer'
    WHEN 7 THEN 'first Answer: A then Answer: c.'
    WHEN 8 THEN ''
    WHEN 9 THEN NULL
    ELSE substr('ABCD', CAST(event_id % 3 AS INT) + 1, 1) END AS prediction
FROM {events}
"""

CIRCULAR = """
SELECT p_partkey * 1009 + r * 1000000000000 AS idx, p_brand AS category, p_brand AS model,
  substr('ABCD', CAST((p_partkey + r) % 4 AS INT) + 1, 1) AS answer, 'one' AS A, 'two' AS B, 'three' AS C, 'four' AS D,
  CASE WHEN p_partkey % 7 = r THEN 'not sure'
       WHEN p_partkey % 9 = 5 AND r = 2 THEN substr('ABCD', CAST((p_partkey + r + 1) % 4 AS INT) + 1, 1)
       ELSE 'Answer: ' || substr('ABCD', CAST((p_partkey + r) % 4 AS INT) + 1, 1) END AS prediction
FROM (SELECT p_partkey, p_brand, 0 AS r FROM {part} UNION ALL SELECT p_partkey, p_brand, 1 AS r FROM {part}
      UNION ALL SELECT p_partkey, p_brand, 2 AS r FROM {part} UNION ALL SELECT p_partkey, p_brand, 3 AS r FROM {part}) p
"""

EXPAND = """
SELECT p_partkey AS idx, p_name AS question, p_brand AS A, p_type AS B,
  CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 5 = 1 THEN 'Both A, B' ELSE p_name END AS C,
  CASE WHEN p_partkey % 5 IN (0, 1, 2) THEN NULL WHEN p_partkey % 5 = 3 THEN 'None of the above'
       ELSE 'size ' || CAST(p_size AS STRING) END AS D,
  substr('AB', CAST(p_partkey % 2 AS INT) + 1, 1) AS answer, 'payload' || CAST(p_partkey AS STRING) AS image
FROM {part}
"""

YES_NO = """
SELECT l.doc_id AS idx, d.lang AS l2_category, d.source AS model,
  CASE WHEN l.toxic = 1 THEN d.source || ',toxic' ELSE d.source END AS category,
  CASE WHEN l.quality = 1 THEN 'Yes' ELSE 'No' END AS answer,
  CASE l.doc_id % 6 WHEN 0 THEN 'Answer: yes' WHEN 1 THEN 'No, it is not.' WHEN 2 THEN 'yes and no'
    WHEN 3 THEN 'YES!' WHEN 4 THEN 'maybe' ELSE 'It is so. Answer: No ' END AS prediction
FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id
"""

PAIRS = """
SELECT o_orderkey AS idx, o_orderpriority AS category, CAST(FLOOR(o_custkey / 2) AS BIGINT) AS image_path,
  CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 END AS score
FROM {orders}
"""

PACKED_KEYS = """
SELECT 'VD_' || event_type || '_x_' || CAST(user_id % 10 AS STRING) || '_' || CAST(event_id % 400 AS STRING) || '_'
    || CAST(event_id % 700 AS STRING) AS idx,
  event_type AS category, 'g' || CAST(user_id % 3 AS STRING) AS l2_category,
  CASE WHEN event_id % 17 = 0 THEN 0 ELSE 1 END AS score
FROM {events}
"""

VQA = """
SELECT p_partkey AS idx, p_brand AS model, p_type AS category, CASE WHEN p_partkey % 2 = 0 THEN 'val' ELSE 'test' END AS split,
  CASE WHEN p_partkey % 4 = 3 THEN p_name
       ELSE '["' || p_name || '", "the ' || p_name || '", "' || p_name || '", "' || p_brand || '"]' END AS answer,
  CASE p_partkey % 6 WHEN 0 THEN 'The answer is ' || p_name || '.' WHEN 1 THEN 'Answer: ' || upper(p_name)
    WHEN 2 THEN substr(p_name, 2, 50) WHEN 3 THEN 'a ' || p_name WHEN 4 THEN p_brand ELSE 'two, three' END AS prediction,
  CAST(CAST(FLOOR(p_retailprice) AS BIGINT) AS STRING) AS num_answer,
  CASE p_partkey % 4 WHEN 0 THEN CAST(CAST(FLOOR(p_retailprice) AS BIGINT) + 20 AS STRING)
    WHEN 1 THEN CAST(CAST(FLOOR(p_retailprice) AS BIGINT) * 2 AS STRING) WHEN 2 THEN '0' ELSE '5%' END AS num_prediction,
  CASE p_partkey % 5 WHEN 0 THEN 'Regular Text Recognition' WHEN 1 THEN 'Digit String Recognition'
    WHEN 2 THEN 'Doc-oriented VQA' WHEN 3 THEN 'Handwritten Mathematical Expression Recognition'
    ELSE 'Scene Text-centric VQA' END AS ocr_category
FROM {part}
"""

TYPED = """
SELECT o_orderkey AS idx, o_orderstatus AS model, o_orderpriority AS task, 's' || CAST(o_custkey % 3 AS STRING) AS category,
  '["algebra", "sk' || CAST(o_custkey % 4 AS STRING) || '"]' AS skills,
  CASE o_orderkey % 4 WHEN 0 THEN 'multi_choice' ELSE 'free_form' END AS question_type,
  CASE o_orderkey % 4 WHEN 1 THEN 'integer' WHEN 2 THEN 'float' ELSE 'text' END AS answer_type,
  '["red", "green", "blue"]' AS choices, substr('ABC', CAST(o_orderkey % 3 AS INT) + 1, 1) AS answer_option,
  CAST(o_custkey % 20 AS STRING) AS answer,
  CASE WHEN o_orderkey % 5 = 0 THEN 'green' WHEN o_orderkey % 5 = 1 THEN CAST(o_custkey % 20 AS STRING) || '.0'
       ELSE CAST(o_custkey % 20 AS STRING) END AS res,
  CASE WHEN o_orderkey % 2 = 0 THEN 'Prefetch succeed' ELSE 'Succeed' END AS log,
  CASE o_orderkey % 4 WHEN 0 THEN 'fintabnetqa' WHEN 1 THEN 'vtabfact' WHEN 2 THEN 'vwtq' ELSE 'vwtq_syn' END AS split,
  CASE o_orderkey % 5 WHEN 0 THEN 'Answer: True' WHEN 1 THEN 'false' WHEN 2 THEN 'true or false'
    WHEN 3 THEN '$1,200 million' ELSE '12 %' END AS prediction,
  CASE o_orderkey % 5 WHEN 0 THEN '1' WHEN 1 THEN '0' WHEN 2 THEN '1' WHEN 3 THEN '1200' ELSE '0.12' END AS table_answer,
  CASE o_orderkey % 4 WHEN 0 THEN 'Int' WHEN 1 THEN 'Float' WHEN 2 THEN 'Str' ELSE 'None' END AS answer_format,
  CASE o_orderkey % 3 WHEN 0 THEN '["Chart"]' WHEN 1 THEN '["Table", "Figure"]' ELSE '[]' END AS evidence_sources,
  CASE o_orderkey % 3 WHEN 0 THEN '[3]' WHEN 1 THEN '[1, 2]' ELSE '[]' END AS evidence_pages
FROM {orders}
"""

JUDGED = """
SELECT event_id AS idx, 'm' || CAST(user_id % 4 AS STRING) AS model,
  CASE event_id % 4 WHEN 0 THEN 'rec,ocr' WHEN 1 THEN 'math' WHEN 2 THEN 'rec,know,gen' ELSE 'ocr,spat' END AS category,
  event_id % 11 AS score10, 1 + user_id % 10 AS gpt4_score,
  CASE WHEN event_id % 13 = 0 THEN -1 ELSE event_id % 4 END AS score,
  CASE event_id % 3 WHEN 0 THEN '["OCR", "Counting"]' WHEN 1 THEN '["Hallucination"]' ELSE '["Social Relation", "OCR"]' END AS dimensions,
  CASE event_id % 3 WHEN 0 THEN 'short' WHEN 1 THEN 'medium' ELSE 'long' END AS duration,
  event_type AS task_type, 'dom' || CAST(user_id % 4 AS STRING) AS domain, 'sub' || CAST(user_id % 6 AS STRING) AS sub_category,
  CASE event_id % 5 WHEN 0 THEN '8 9' WHEN 1 THEN '8, 9' WHEN 2 THEN '7' WHEN 3 THEN '7.5 8' ELSE 'bad text' END AS review,
  CASE event_id % 6 WHEN 0 THEN '0.5' WHEN 1 THEN '1.0' WHEN 2 THEN '1.5' WHEN 3 THEN 'fine' WHEN 4 THEN '-0.1' ELSE '0.25' END AS unit_reply,
  CASE event_id % 7 WHEN 0 THEN 'no idea' WHEN 1 THEN '2.0' WHEN 2 THEN NULL ELSE CAST(event_id % 4 AS STRING) END AS int_reply,
  'ok {{"Creativity": ' || CAST(event_id % 13 AS STRING) || ', "Richness": 5}}' AS dims_reply
FROM {events}
"""

RUNS = """
SELECT 'm' || CAST(o_custkey % 5 AS STRING) AS model, o_orderpriority AS dataset, CAST(FLOOR(o_orderkey / 2) AS BIGINT) AS idx,
  o_orderkey % 2 AS source_priority, o_orderkey AS pos,
  CASE WHEN o_orderkey % 10 = 0 THEN 'Failed to obtain answer via API.' ELSE 'ok ' || CAST(o_orderkey AS STRING) END AS prediction,
  CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS hit
FROM {orders}
"""

SUBTITLES = """
SELECT event_id AS pos, user_id % 20 AS video, (event_id * 37) % 100000 AS start_ms,
  (event_id * 37) % 100000 + CASE WHEN event_id % 997 = 996 THEN 360000000 ELSE 500 + (event_id % 5) * 400 END AS end_ms,
  CASE WHEN event_id % 19 = 0 THEN ' ' ELSE event_type || chr(92) || 'N' || CAST(event_id % 7 AS STRING) END AS text
FROM {events}
"""

FRAMES = """
SELECT c_custkey AS frame_id, c_custkey % 20 AS video, (c_custkey * 53) % 100000 AS t_ms, 100 + c_custkey % 900 AS n_frames
FROM {customer}
"""

DIALOGUES = """
SELECT event_id AS idx, 'm' || CAST(user_id % 3 AS STRING) AS model,
  slice(array('What is ' || event_type || '?', 'Why for user ' || CAST(user_id AS STRING) || '?', 'And then?'), 1, CAST(1 + event_id % 3 AS INT)) AS question,
  array(event_type, 'because', 'nothing') AS answer, array('It is ' || event_type, 'As user ' || CAST(user_id AS STRING) || ' said') AS prediction
FROM {events}
"""

CAPTIONS = """
SELECT d.doc_id AS idx, d.text AS prediction, b.item_id, b.text AS ref_text, 0 AS ref
FROM {documents} d JOIN {benchmark} b ON d.doc_id % (SELECT COUNT(*) FROM {benchmark}) = b.item_id
UNION ALL
SELECT d.doc_id AS idx, d.text AS prediction, b.item_id, b.text AS ref_text, 1 AS ref
FROM {documents} d JOIN {benchmark} b ON (d.doc_id + 7) % (SELECT COUNT(*) FROM {benchmark}) = b.item_id
"""

CAPTION_ROWS = """
SELECT d.doc_id AS idx, d.text AS prediction, a.text AS first, b.text AS second
FROM {documents} d JOIN {benchmark} a ON d.doc_id % (SELECT COUNT(*) FROM {benchmark}) = a.item_id
  JOIN {benchmark} b ON (d.doc_id + 7) % (SELECT COUNT(*) FROM {benchmark}) = b.item_id
"""

CAPTION_RUNS = """
SELECT m.model, d.lang AS dataset, d.doc_id AS idx, a.text AS first, b.text AS second,
  CASE m.model WHEN 'echo' THEN d.text ELSE substr(b.text, 1, CAST(10 + d.doc_id % 90 AS INT)) || ' ' || substr(a.text, 20, 60) || ' ' || substr(d.text, 1, 100) END AS prediction
FROM {documents} d JOIN {benchmark} a ON d.doc_id % (SELECT COUNT(*) FROM {benchmark}) = a.item_id
  JOIN {benchmark} b ON (d.doc_id + 7) % (SELECT COUNT(*) FROM {benchmark}) = b.item_id
  JOIN (SELECT 'echo' AS model UNION ALL SELECT 'mixed' AS model) m ON 1 = 1
"""

IMAGES = """
SELECT o_orderkey AS idx, CASE WHEN o_orderkey % 3 = 1 THEN CAST(o_orderkey - 1 AS STRING)
  ELSE repeat('x', 70) || CAST(o_orderkey AS STRING) END AS image
FROM {orders}
"""

TURNS = """
SELECT conv_id, turn, role, CASE WHEN role = 'user' AND turn % 4 = 0 THEN '<ImageHere>' || text ELSE text END AS text
FROM {conversations}
"""
