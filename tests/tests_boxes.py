BOX = "doc_id long, node_ix int, text string, left double, top double, right double, bottom double"


def boxes(spark, rows):
    return spark.createDataFrame([(*r[:3], *map(float, r[3:])) for r in rows], BOX)
