"""The semantics of one linked-data document in plain Python, without Spark.

The DataFrame operators run these functions on the executors, over Arrow batches
of documents, wherever a document's shape is not known when the plan is built.
"""
