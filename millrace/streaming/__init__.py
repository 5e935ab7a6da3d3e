from millrace.streaming.rates import rate_limit_stream, throttle_stream

__all__ = ["rate_limit_stream", "throttle_stream"]
