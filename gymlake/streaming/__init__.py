"""gymlake.streaming"""
