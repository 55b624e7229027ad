"""gymlake.operators"""
