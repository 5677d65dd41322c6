"""Table layouts of the engine."""

ENTITIES = "idx bigint, qid string"
TITLES = "wiki string, title string, idx bigint"
EDGES = "prop string, src bigint, dst bigint, pos int"
ATTRIBUTES = "prop string, entity bigint, value int"
ANCHORS = "anchor_id bigint, anchor string"
CANDIDATES = "anchor_id bigint, entity bigint, cnt bigint, pos int"
CLASSES = "scheme string, class_id int, name string"
CLASSIFICATION = "scheme string, entity bigint, class_id int"
TOKENS = "doc_id bigint, para int, pos bigint, token string, qid string, context_qid string, anchor_id bigint"
MENTIONS = "mention_id bigint, doc_id bigint, start bigint, stop bigint, anchor_id bigint, label bigint"
SCORES = "mention_id bigint, entity bigint, score double"
