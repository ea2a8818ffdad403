"""gullwatch: find and organise security-relevant short posts with Spark."""
