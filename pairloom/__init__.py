"""pairloom: Spark-native analytics for evidence-pair tables.

Every public function takes and returns a DataFrame; nothing is collected
except bounded metadata (schemas, fold plans, iteration control).
"""
