"""splitlane: experiment analytics as Spark jobs.

Start and finish events of many apps become labelled session samples, features,
tree models of conversion and variation choices, in batch or as streams.
"""
