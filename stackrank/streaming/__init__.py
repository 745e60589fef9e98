from stackrank.streaming.scoring import read_scores, start_scoring

__all__ = ["start_scoring", "read_scores"]
