"""rollscope: Spark-native scoring, cleaning and monitoring of model rollouts.

* ``rollscope.functions`` -- column expressions (text, distributions, boxes, assignment)
* ``rollscope.operators`` -- DataFrame operators (rewards, group statistics, tokens, prompts, diff)
* ``rollscope.sources``   -- readers and partitioned writers
* ``rollscope.streaming`` -- Structured Streaming operators
* ``rollscope.plans``     -- fixtures from the given tables, the query registry and its SQL oracles
* ``rollscope.session``   -- SparkSession defaults and the shared checkpoint folder
"""
