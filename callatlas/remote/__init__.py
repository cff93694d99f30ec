"""The remote labeller: requests with retries, breaker, budget and cache, and labels for conversations that have none."""
